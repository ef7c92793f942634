"""Chat formatting by columnar byte assembly.

A turn becomes ``<|turn|>role\\n`` + text + ``<|end|>\\n``. For a batch of turns the lengths of all
segments are known beforehand; their running sum gives every segment's place, and headers, contents
and footers are scattered into one preallocated buffer, which then is an Arrow array's data as it is.
A mask names the bytes of assistant texts, for the loss.

Control strings inside a text get a backslash after their first character, on top of those that are
there; taking one away restores them, so any text survives. Backslashes and newlines of a role are
escaped too.

Turns are sorted by (conv_id, turn, role, text) over range partitions, so a long conversation spreads
over several, and is kept in chunks of whole turns. Digests are taken while chunks stream past in order.

Cases: a null text or role is empty; turns without conv_id form a conversation of their own; null
turns come first; equal turns are ordered by role and text, and repeated rows stay. An empty text is a
turn. An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from . import text as tx

TURN, END = "<|turn|>", "<|end|>\n"
TRAINED = "assistant"
# Strings that chat templates give a meaning to.
CONTROL = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[]\\*)(?={_TAILS})")
_ESCAPED = re.compile(rf"([<\[]\\*)\\(?={_TAILS})")
#: The same without a lookahead, for engines that have none; no control string begins inside another's tail.
ANY_CONTROL = rf"[<\[]\\*(?:{_TAILS})"
#: Bytes of texts that are assembled together.
SLICE_BYTES = 64 << 20
CHUNKS = "conv_id long, part int, chunk int, n_turns long, formatted binary, mask array<long>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _escaped(texts: pa.Array) -> pa.Array:
    touched = pc.match_substring_regex(texts, ANY_CONTROL)
    if not pc.any(touched).as_py():
        return texts
    new = pa.array([escape(x) for x in texts.filter(touched).to_pylist()], texts.type)
    return pc.replace_with_mask(texts, touched, new)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer, the place of each turn (one more at the end), and of each text."""
    coded = roles.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    headers = [np.frombuffer(f"{TURN}{_role_out(r)}\n".encode(), np.uint8) for r in coded.dictionary.to_pylist()]
    footer = np.frombuffer(END.encode(), np.uint8)
    buf, offs = tx.flat(_escaped(texts))
    long = np.array([len(h) for h in headers], np.int64)[code] if len(code) else np.zeros(0, np.int64)
    size = np.diff(offs)
    places = np.zeros(len(size) + 1, np.int64)
    np.cumsum(long + size + len(footer), out=places[1:])
    out = np.empty(int(places[-1]), np.uint8)
    for k, h in enumerate(headers):
        out[places[:-1][code == k][:, None] + np.arange(len(h))] = h
    begin = places[:-1] + long
    out[np.repeat(begin - offs[:-1], size) + np.arange(len(buf))] = buf
    out[(begin + size)[:, None] + np.arange(len(footer))] = footer
    return out, places, begin


def format_turns(turns: DataFrame) -> DataFrame:
    """Chunks of formatted conversations: conv_id, part, chunk, n_turns, formatted, mask.

    part and chunk order the chunks of a conversation; mask holds first and past-the-last byte of each
    assistant text in the chunk.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        part, chunk = TaskContext.get().partitionId(), 0
        for batch in (b.slice(x, y - x) for b in batches for x, y in tx.slices(tx.flat(b.column(3))[1], SLICE_BYTES)):
            ids = batch.column(0)
            out, places, begin = assemble(batch.column(2), batch.column(3))
            key = ids.fill_null(0).to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], (np.diff(key) != 0) | (np.diff(null.view(np.int8)) != 0))))
            bounds = np.append(first, len(key))
            stop = places[1:] - len(END)
            trained = pc.equal(batch.column(2), TRAINED).to_numpy(zero_copy_only=False)
            start_of = np.repeat(places[first], np.diff(bounds))
            mask = np.stack([begin - start_of, stop - start_of], 1)[trained].ravel()
            mask_bounds = np.concatenate(([0], np.cumsum(trained)))[bounds] * 2
            formatted = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(places[bounds]), pa.py_buffer(out)])
            yield pa.RecordBatch.from_pydict({
                "conv_id": ids.take(pa.array(first)), "part": pa.array(np.full(len(first), part, np.int32)),
                "chunk": pa.array(np.arange(chunk, chunk + len(first), dtype=np.int32)), "n_turns": pa.array(np.diff(bounds)),
                "formatted": formatted.cast(pa.binary()), "mask": pa.ListArray.from_arrays(pa.array(mask_bounds.astype(np.int32)), pa.array(mask)),
            })
            chunk += len(first)

    return ordered.select("conv_id", "turn", "role", "text").mapInArrow(run, CHUNKS)


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """(role, text) of each turn, as they were before formatting."""
    out = []
    for piece in formatted.decode().split(TURN)[1:]:
        role, _, text = piece.partition("\n")
        out.append((_role_in(role), unescape(text[: -len(END)])))
    return out


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of conversations, from their formatted chunks."""
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chunks.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        nothing = object()
        now, state = nothing, None

        def done():
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    if now is not nothing:
                        rows.append(done())
                    now, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = row["formatted"]
                for role, text in parse(data):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s, e in zip(row["mask"][0::2], row["mask"][1::2], strict=True):
                    text = unescape(data[s:e].decode())
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(data.decode())
            if rows:
                yield _table(rows)
        if now is not nothing:
            yield _table([done()])

    def _table(rows):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """Format turns, write the chunks, and read their digests back."""
    return read_back(files.saved(format_turns(turns), "chat"))
