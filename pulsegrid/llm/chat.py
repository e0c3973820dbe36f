"""Chat formatting in budgeted windows.

The prefix sums of a conversation's turn tokens choose the spans. With room for ``S`` new tokens, offset ``x`` lies in
cell ``x div S``: the turns that lie inside a cell are a span, a turn that crosses into the next cell joins the
span before it if both fit together, and is a span of its own otherwise. So every span is a run of whole turns of at most
``S`` tokens (or one longer turn), found from the sums alone, with no walk along the conversation. Each later span
gets the system turn again and the last turns of the span before it, as many as fit the history's budget; what is
repeated is context and has no loss.

Turns are marked by control strings. Inside a text, a control string gets a backslash after its first character
(and one more if there are some already), so a text never holds one and gets back what it had.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pulsegrid.llm import bpe
from pulsegrid.llm.common import spread_join, with_text_columns
from pulsegrid.session import cut_lineage

#: The marks of this template, and those of others that texts may hold.
START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
CONTROL = (START, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")


#: Characters of a text that decide between turns of one number and role.
TIE_CHARS = 64


@dataclass(frozen=True)
class Budget:
    """Tokens of a window: in all, kept for the system turn, and for history. The rest is for new turns."""

    window: int = 4096
    system: int = 512
    history: int = 512

    @property
    def new(self) -> int:
        return self.window - self.system - self.history


_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def windows(turns: DataFrame, vocabulary: str, budget: Budget = Budget(), target: str = "assistant", slice: int = 512) -> DataFrame:
    """Conversations as training windows, from columns ``conv_id, turn, role, text``.

    Returns ``conv_id, span`` (tokens of the conversation before it), ``n_turns, n_context`` (how many turns at the head are
    repeated), ``n_tokens, text`` and ``loss``, an array of ``(begin, end)`` code points: the new texts of role ``target``.

    Null texts and roles count as empty. Turns go by number (null first), ties by role, the first
    characters of the text and a hash of it; repeated rows are turns of their own. Rows with a null ``conv_id`` are one conversation. An empty table gives an empty one. Other columns
    are ignored. The system turn is a first turn of role ``system``; a window exceeds its budget only where a single turn
    or the system turn does.

    A conversation of any length is cut into slices of ``slice`` turn numbers for the sums, and a window is the largest thing
    that meets in one task. Texts are written once, move to their windows once they are known, and meet there.
    """
    base = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("escaped"))
    marked = base.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(BODY))).withColumn(
        "formatted", F.concat("head", "escaped", F.lit(END))).withColumn("chars", F.length("formatted"))

    def make():
        encoder = bpe.vocabulary(vocabulary).chunks
        return lambda texts: [pa.array(np.maximum(1, encoder.count(texts)))]

    stored = cut_lineage(with_text_columns(marked, "formatted", [T.StructField("tokens", T.LongType())], make, keep=False).select(
        F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", "escaped", F.length("head").alias("head_chars"), "chars", "tokens"), "turns")
    # From here to the last join only numbers move, no texts.
    slim = stored.select("row", "conv_id", F.coalesce(F.floor(F.col("turn") / slice), F.lit(-(1 << 62))).alias("slice"), "turn", "role",
                         F.substring("escaped", 1, TIE_CHARS).alias("beginning"), F.xxhash64("escaped").alias("hash"), "tokens")
    # Prefix sums in two levels: within a slice, and over the slices' totals.
    order = [F.col("turn").asc_nulls_first(), "role", "beginning", "hash", "row"]
    inside = Window.partitionBy("conv_id", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = slim.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    sums = slim.groupBy("conv_id", "slice").agg(F.sum("tokens").alias("sum"))
    along = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), F.coalesce(F.sum("sum").over(along), F.lit(0)).alias("offset"),
                          F.sum("sum").over(Window.partitionBy("conv_id")).alias("all"))
    placed = (numbered.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")))
              .withColumn("before", F.col("before") + F.col("offset")).withColumn("after", F.col("before") + F.col("tokens"))
              .withColumn("cell", F.expr(f"before div {budget.new}"))
              .withColumn("inside", F.expr(f"(after - 1) div {budget.new}") == F.col("cell"))
              .withColumn("system", (F.col("before") == 0) & (F.col("role") == "system")))
    # A turn has a token at least, so a cell has no more turns than tokens.
    cell = Window.partitionBy("conv_id", "cell")
    first = F.min(F.when(F.col("inside"), F.col("before"))).over(cell)
    joins = F.col("inside") | (F.col("after") - F.col("first") <= budget.new)
    spans = placed.withColumn("first", first).withColumn("span", F.when(joins, F.col("first")).otherwise(F.col("before")))
    spans = cut_lineage(spans.withColumn("until", F.max("after").over(Window.partitionBy("conv_id", "cell", "span")))
                        .select("row", "conv_id", "span", "before", "until", "all", "system"), "spans")
    # One row a turn and window that shows it: itself, and as history of the next window.
    again = (F.col("until") - F.col("before") <= budget.history) & (F.col("until") < F.col("all")) & ~F.col("system")
    shown = spans.withColumn("shown", F.explode(F.array_compact(F.array(
        F.struct(F.lit(2).alias("kind"), F.col("span").alias("at")), F.when(again, F.struct(F.lit(1).alias("kind"), F.col("until").alias("at")))))))
    rows = shown.select("conv_id", F.col("shown.at").alias("span"), F.col("shown.kind").alias("kind"), "before", "row")
    systems = spans.where("system").select("conv_id", "before", "row")
    later = spans.where("span > 0").select("conv_id", "span").distinct()
    context = spread_join(later, systems, "conv_id", F.col("span")).select("conv_id", "span", F.lit(0).alias("kind"), "before", "row")
    every = rows.union(context).join(stored.select("row", "role", "escaped", "head_chars", "chars", "tokens"), "row").withColumn(
        "formatted", F.concat(F.lit(START), escape(F.col("role")), F.lit(BODY), "escaped", F.lit(END)))
    window = Window.partitionBy("conv_id", "span").orderBy("kind", "before")
    at = F.coalesce(F.sum("chars").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("head_chars")
    spot = F.when((F.col("kind") == 2) & (F.col("role") == target), F.struct(
        F.col("at").cast("int").alias("begin"), (F.col("at") + F.length("escaped")).cast("int").alias("end")))
    parts = every.withColumn("at", at).select("conv_id", "span", "kind", "before", "tokens", "formatted", spot.alias("spot"))
    grouped = parts.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list(F.struct("kind", "before", "formatted", "spot"))).alias("p"),
        F.count(F.lit(1)).cast("int").alias("n_turns"), F.count_if(F.col("kind") < 2).cast("int").alias("n_context"), F.sum("tokens").alias("n_tokens"))
    return grouped.select("conv_id", "span", "n_turns", "n_context", "n_tokens", F.array_join("p.formatted", "").alias("text"),
                          F.array_compact("p.spot").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What windows say about their conversations, from their text and loss spans alone.

    ``conv_id, n_turns, turns_sha256`` (of role, newline, text, newline of each turn once), ``loss_chars, loss_sha256`` (of
    the text under the loss spans, unescaped) and ``formatted_chars``. A digest runs along a conversation, so a conversation
    is one stream through one task, window by window; nothing of it is held.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = False, None
        done: list[tuple] = []

        def close():
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for conv, text, context, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "n_context", "loss")), strict=True):
                if not open_ or conv != state[0]:
                    if open_:
                        close()
                    open_, state = True, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in _TURN.findall(text)[context:]:
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for spot in loss:
                    plain = unescape(text[spot["begin"]:spot["end"]])
                    state[3] += len(plain)
                    state[4].update(plain.encode())
                state[5] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=arrow)
                done = []
        if open_:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=arrow)

    arrow = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
    return (formatted.select("conv_id", "span", "text", "n_context", "loss").repartition("conv_id")
            .sortWithinPartitions("conv_id", "span").mapInArrow(run, schema))
