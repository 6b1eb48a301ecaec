"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only
its own text is under the loss mask.  Template: a conversation starts with ``<s>``, a turn is

    [TURN role]\\n text </s>          (without the blanks around text)

Control strings inside roles and texts are escaped: a backslash is doubled, and a single
backslash is put after the first character of a control string (in roles also before ``]``), so a
formatted text holds control strings only where the template puts them, and ``unescape``
gives back the text.

Every example is written out with its whole context.  A conversation's formatted text is cut at turn
ends into blocks of about ``RUN_CHARS`` characters; an example that ends in the first block, as in all but
very long conversations, is one row, any other has a row (part) for each block up to its own: the
texts of its parts one after the other are the example (``rendered``).  Turns after the last reply end an
example without a target.

A conversation's turns are streamed in order; a task holds one block of turns, whatever the
length of the conversation.  Earlier blocks are joined to the examples that need them, some examples
of a block at a time.  The files hold each example in full, so they grow with the square of a conversation's length
before compression; zstd finds the repeated context of neighbouring rows.

Defined results: turns are ordered by turn, then role and text (ties); null text or role is empty; a null
turn comes first; rows with a null conv_id are one conversation; repeated rows are turns
like others; a role other than ``assistant`` is context; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maplift.llm.common import prepare, staged

START, END, TURN = "<s>", "</s>", "[TURN "
#: Strings with a meaning in this template or in common chat templates (fixed values).
CONTROL = ("<s>", "</s>", "[TURN ", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TARGET_ROLE = "assistant"
#: Characters of a block: longer formatted texts are stored in parts of about this size.
RUN_CHARS = 1 << 18
#: Examples that a block is joined to at a time.
EXAMPLES = 64

_SPECIAL = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_HEAD = re.compile(r"\[TURN ((?:\\.|[^\\\]])*)\]\n", re.S)
_OUT = ["conv_id", "example", "part", "target_turn", "text", "loss_start", "loss_end", "context_chars", "last"]
_SCHEMA = ("conv_id long, example long, part long, target_turn long, text string, loss_start long, loss_end long, "
           "context_chars long, last boolean")
_TYPES = {"text": pa.string(), "last": pa.bool_()}


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("]", "\\]")


def head(role: str) -> str:
    return f"{TURN}{escape_role(role)}]\n"


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of formatted text."""
    out, at = [], len(START) if text.startswith(START) else 0
    while at < len(text):
        m = _HEAD.match(text, at)
        stop = text.index(END, m.end())
        out.append((unescape(m[1]), unescape(text[m.end(): stop])))
        at = stop + len(END)
    return out


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.record_batch([pa.array(c, _TYPES.get(n, pa.int64())) for n, c in zip(_OUT, cols)], names=_OUT)


def _expanded(batches: Iterable[pa.RecordBatch], run_chars: int) -> Iterator[pa.RecordBatch]:
    """Each example's part in the block it ends in, and (example null) each block that has turns after it."""
    nothing = object()
    key, example, part, context, block, size, ready, out, held = nothing, 0, 0, 0, [], 0, None, [], 0

    def ended():
        if key is not nothing:  # turns after the last reply are an example without a target
            out.append((*(ready or (key, example, part, None, "".join(block), None, None, context)), True))

    for conv, turn, role, text in _stream(batches):
        if key is nothing or conv != key:
            ended()
            held += size
            key, example, part, context, block, size, ready = conv, 0, 0, 0, [START], len(START), None
        if ready:
            out.append((*ready, False))
            ready = None
        if size > run_chars:
            out.append((key, None, part, None, "".join(block), None, None, context, None))
            held += size
            part, context, block, size = part + 1, context + size, [], 0
        first, body = head(role), escape(text)
        start = size + len(first)
        block.append(first + body + END)
        size = start + len(body) + len(END)
        if role == TARGET_ROLE:
            block = ["".join(block)]
            ready = (key, example, part, turn, block[0], start, start + len(body), context)
            example += 1
            held += size
        if held > run_chars and out:
            yield _record(out)
            out, held = [], 0
    ended()
    if out:
        yield _record(out)


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, part, target_turn, text, loss_start, loss_end, context_chars, last (see above).

    Written to the shared folder and read again.  Loss offsets are code points of the text of an example's last part, the others
    have none; context_chars: the example's characters before the part; last: of the conversation's last example."""
    prepare(conversations.sparkSession)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    run_chars = RUN_CHARS
    found = staged(turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
                   .mapInArrow(lambda batches: _expanded(batches, run_chars), _SCHEMA), "chat", compression="zstd")
    examples, blocks = found.where("example is not null"), found.where("example is null")
    if blocks.isEmpty():
        return examples
    return examples.union(staged(_earlier_parts(examples, blocks), "chat-parts", compression="zstd"))


def _earlier_parts(examples: DataFrame, blocks: DataFrame) -> DataFrame:
    """The parts of examples before the block they end in; a block is moved once for each EXAMPLES examples."""
    asked = (examples.where("part > 0").select(
        F.col("conv_id").alias("conv"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("part") - 1)).alias("at"),
        F.struct("example", "target_turn", "last").alias("e"))
        .groupBy("conv", "at", F.floor(F.col("e.example") / EXAMPLES).alias("chunk")).agg(F.collect_list("e").alias("es")))
    both = (blocks.select("conv_id", "part", "text", "context_chars")
            .join(asked, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("at"))))
    none = F.lit(None).cast("long")
    return (both.repartition("conv_id", "part", "chunk").withColumn("e", F.explode("es"))
            .select("conv_id", "e.example", "part", "e.target_turn", "text", none.alias("loss_start"), none.alias("loss_end"),
                    "context_chars", "e.last"))


def rendered(examples: DataFrame) -> DataFrame:
    """conv_id, target_turn, text, loss_start, loss_end of every example whose reply has a turn number: its parts in one text."""
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]))
    return (examples.where("target_turn is not null").groupBy("conv_id", "example", "target_turn")
            .agg(joined.alias("text"), F.max(F.col("context_chars") + F.col("loss_start")).alias("loss_start"),
                 F.max(F.col("context_chars") + F.col("loss_end")).alias("loss_end"))
            .select("conv_id", "target_turn", "text", "loss_start", "loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of conversations from their written examples: the turns of the last example, the text under each
    example's loss mask, the size of all examples."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        key, n, chars, size, turns, loss, done = nothing, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), []

        def record():
            return pa.record_batch([pa.array(c) for c in zip(*done)],
                                   schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                                                     ("formatted_chars", pa.int64())]))
        for conv, _, _, length, said, text in _stream(batches):
            if key is nothing or conv != key:
                if key is not nothing:
                    done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                key, n, chars, size, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            size += length
            if said is not None:
                said = unescape(said)
                chars += len(said)
                loss.update(said.encode())
            for role, body in parse(text) if text is not None else ():
                n += 1
                turns.update(f"{role}\n{body}\n".encode())
            if len(done) >= 1000:
                yield record()
                done = []
        if key is not nothing:
            done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            yield record()
    # only what the digests need is moved: a context is in many examples
    said = F.substring(F.col("text"), F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = examples.select("conv_id", "example", "part", F.length("text").cast("long").alias("length"), said.alias("said"),
                           F.when(F.col("last"), F.col("text")).alias("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "example", "part").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def formatted(conversations: DataFrame) -> DataFrame:
    """The examples as they were written to the shared folder."""
    return prefix_target_examples(conversations)
