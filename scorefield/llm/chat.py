r"""Chat formatting: turns become one training text with a loss mask, by columnar assembly of bytes.

A turn is `### ` role `: ` text ` </turn>` and a line feed. Backslash, `#` and `<` inside texts, and `:` inside roles
too, get a backslash before them, so that no text holds a control string and reading back is exact. For all turns of a
batch the lengths of the pieces give their offsets, and one scatter fills a preallocated buffer.

Turns are dealt by conversation and sorted; a conversation is then read as a stream, so that a hot one needs no more
memory than a batch.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, read_table, sorted_stream, text_bytes

HEAD, COLON, TAIL = b"### ", b": ", b" </turn>\n"
TRAINED = "assistant"
_special = np.zeros(256, bool)
_special[list(b"\\#<")] = True
_special_role = _special.copy()
_special_role[ord(":")] = True


def _escaped_sizes(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the escapes up to it, and the size of each piece when escaped."""
    more = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=more[1:])
    return more, np.diff(at) + np.diff(more[at])


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer, the offsets of the turns in it, and where each turn's escaped text begins and ends."""
    role, role_at = text_bytes(roles)
    text, text_at = text_bytes(texts)
    role_more, role_size = _escaped_sizes(role, role_at, _special_role)
    text_more, text_size = _escaped_sizes(text, text_at, _special)
    size = len(HEAD) + role_size + len(COLON) + text_size + len(TAIL)
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    out = np.full(int(at[-1]), ord("\\"), np.uint8)
    role_from = at[:-1] + len(HEAD)
    text_from = role_from + role_size + len(COLON)
    text_to = text_from + text_size
    for piece, begin in ((HEAD, at[:-1]), (COLON, role_from + role_size), (TAIL, text_to)):
        out[begin[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    for data, data_at, more, begin in ((role, role_at, role_more, role_from), (text, text_at, text_more, text_from)):
        # a byte stands after all bytes of its piece before it, and after an escape for each special one up to itself
        shift = np.repeat(begin - data_at[:-1] - more[data_at[:-1]], np.diff(data_at))
        out[np.arange(len(data)) + shift + more[1:]] = data
    return out, at, text_from, text_to


def read_back(turn: bytes) -> tuple[bytes, bytes]:
    """Role and text of one formatted turn."""
    a = np.frombuffer(turn, np.uint8)
    slash = a == ord("\\")
    n = np.arange(len(a))
    run = np.maximum.accumulate(np.where(slash, -1, n))  # the last byte that is no backslash
    escape = slash & ((n - run) % 2 == 1)
    literal = np.zeros(len(a), bool)
    literal[1:] = escape[:-1]
    cut = int(np.flatnonzero((a == ord(":")) & ~literal)[0])
    keep = ~escape
    return a[len(HEAD) : cut][keep[len(HEAD) : cut]].tobytes(), a[cut + len(COLON) : len(a) - len(TAIL)][keep[cut + len(COLON) : len(a) - len(TAIL)]].tobytes()


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted (the turn's part of its conversation's text), loss_from and loss_to (code points of
    formatted under the loss mask; equal where there are none), sorted by conversation and turn inside each partition.

    A conversation's text is the concatenation of its turns. Null roles and texts are empty; null conv_ids are one
    conversation and a null turn comes first; equal turns follow by role and text, and repeated rows are turns of their own. Texts
    of any length are taken whole (a turn has less than 2 GiB, escapes counted); an empty table gives no rows. Other columns
    are ignored.
    """

    def scan(batches):
        for part in chunks(batches):
            out, at, text_from, text_to = assemble(part.column(2), part.column(3))
            trained = np.array([r == TRAINED for r in part.column(2).to_pylist()], bool)
            points = np.zeros(len(out) + 1, np.int64)
            np.cumsum((out & 0xC0) != 0x80, out=points[1:])
            lo, hi = points[text_from] - points[at[:-1]], points[text_to] - points[at[:-1]]
            formatted = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), formatted, pa.array(np.where(trained, lo, 0)), pa.array(np.where(trained, hi, 0))], ["conv_id", "turn", "formatted", "loss_from", "loss_to"])

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    a, b = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text").mapInArrow(scan, f"conv_id {a}, turn {b}, formatted string, loss_from long, loss_to long")


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What can be read back from format_turns, per conversation: see op3_chat_formatting. Holds one turn at a time."""

    class Open:
        def __init__(self):
            self.turns, self.points, self.loss = 0, 0, 0
            self.all, self.trained = hashlib.sha256(), hashlib.sha256()

    def scan(batches):
        held, name, done = None, None, []

        def out():
            columns = list(zip(*done))
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close():
            done.append((name, held.turns, held.all.hexdigest(), held.loss, held.trained.hexdigest(), held.points))

        for batch in batches:
            for conv, turn, lo, hi in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if held is None or conv != name:
                    if held is not None:
                        close()
                    held, name = Open(), conv
                role, text = read_back(turn.encode())
                held.turns += 1
                held.points += len(turn)
                held.all.update(role + b"\n" + text + b"\n")
                if hi > lo:
                    masked = read_back(f"### : {turn[lo:hi]} </turn>\n".encode())[1]
                    held.trained.update(masked)
                    held.loss += len(masked.decode())
            if len(done) > 5000:
                yield out()
        if held is not None:
            close()
        if done:
            yield out()

    return formatted.withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(scan, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_formatting(spark, sf_dir):
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest_conversations(format_turns(given.unionByName(probe)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(15 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
