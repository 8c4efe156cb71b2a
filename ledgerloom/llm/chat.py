"""Preference formatting: one prompt, two masked completions.

The turns that a chosen and a rejected conversation share at their start are rendered once; what follows in each is its
completion. A mask says which characters of a completion are the assistant's and so count in training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

#: The turn markers of the chat template. Inside a text they are broken by a space.
BEGIN, END, BROKEN = "<|im_start|>", "<|im_end|>", "<| im_"
ASSISTANT = "assistant"
_SPANS = "array<struct<first: int, last: int>>"


def conversation_turns(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """(conv_id, turns): an array of (turn, role, text) in order for each conversation; equal turn numbers by role and
    text. Rows without an id belong to no conversation. A conversation must fit into a row, as its text must."""
    return turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("turn"), "role", "text"))).alias("turns")
    )


def _head(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|im_"), F.lit(BROKEN)), F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans of the assistant's words and end markers in the rendered turns, in code points."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + F.length(_head(turn))
        last = first + F.length(_body(turn))
        own = F.array(F.struct(first.alias("first"), last.alias("last")))
        spans = F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], own)).otherwise(state["spans"])
        return F.struct((last + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """`pairs` with the columns prompt_turns, prompt, chosen_text, rejected_text, chosen_mask and rejected_mask.

    `chosen` and `rejected` are arrays of structs with role and text (other fields don't count). Turns are the same if
    role and text are, null equal to null. A null array has no turns; where one conversation is the beginning of the
    other its completion is empty. Null role or text are rendered empty. Every row stays, repeated or not; an empty table
    gives none. Columns of the names that are added must not be there yet; any others may.
    """

    made = ["prompt_turns", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask"]
    if clash := sorted(set(made) & set(pairs.columns)):
        raise ValueError(f"there are columns {clash} already")

    def plain(c: Column) -> Column:
        turns = F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return F.coalesce(turns, F.array().cast("array<struct<role: string, text: string>>"))

    # own columns travel as one struct, so none of their names can clash with those in between
    own = F.struct(*[F.col(f"`{c}`") for c in pairs.columns]).alias("own")
    both = pairs.select(own, plain(F.col(f"`{chosen}`")).alias("a"), plain(F.col(f"`{rejected}`")).alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    shared = F.when(differ > 0, differ - 1).otherwise(F.size("a")).cast("int")
    counted = both.withColumn("n", shared)
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n")))
    cut = counted.select("own", "n", F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    values = [F.col("n"), _rendered(F.col("p")), _rendered(F.col("a")), _rendered(F.col("b")), _mask(F.col("a")), _mask(F.col("b"))]
    return cut.select(*[F.col("own").getField(c).alias(c) for c in pairs.columns], *[v.alias(c) for v, c in zip(values, made, strict=True)])


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Preference pairs from a table of conversations: each is chosen against itself with its last assistant turn taken
    from its partner, the conversation whose id differs in the lowest bit.

    Conversations without an assistant turn are cut nowhere; without a partner's answer the rejected one just ends."""
    talks = conversation_turns(turns)
    marked = talks.withColumn("said", F.filter("turns", lambda t: t["role"] == ASSISTANT))
    last = F.try_element_at("said", F.lit(-1))
    at = F.when(F.size("said") > 0, F.size("turns") - F.array_position(F.reverse("turns"), last).cast("int")).otherwise(F.size("turns"))
    answers = marked.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), last.alias("answer"))
    joined = marked.select("conv_id", "turns", at.alias("at")).join(answers, "conv_id", "left")
    before = F.slice("turns", F.lit(1), F.col("at"))
    other = F.when(F.col("answer").isNotNull(), F.concat(before, F.array("answer"))).otherwise(before)
    return joined.select("conv_id", F.col("turns").alias("chosen"), other.alias("rejected"))


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_preferences(swapped_answers(table(spark, sf_dir, "conversations")))

    def shown(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["first"], s["last"])), ",")

    return pairs.select(
        "conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen_text", "rejected_text",
        shown("chosen_mask").alias("chosen_mask"), shown("rejected_mask").alias("rejected_mask"),
    )


OP2_SQL = r"""
WITH turns AS (
    SELECT conv_id, role, text, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
    FROM conversations WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), cut AS (
    SELECT conv_id, max(n) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS last FROM turns GROUP BY conv_id
), answers AS (
    SELECT t.conv_id, t.role, t.text FROM turns t JOIN cut c ON c.conv_id = t.conv_id AND c.last = t.i
), rejected AS (
    SELECT t.conv_id, t.i, t.role, t.text FROM turns t JOIN cut c ON c.conv_id = t.conv_id WHERE c.last IS NULL OR t.i < c.last
    UNION ALL
    SELECT c.conv_id, coalesce(c.last, c.n + 1), a.role, a.text FROM cut c JOIN answers a ON a.conv_id = xor(c.conv_id, 1)
), compared AS (
    SELECT coalesce(t.conv_id, r.conv_id) AS conv_id, coalesce(t.i, r.i) AS i,
           t.i IS NOT NULL AND r.i IS NOT NULL AND t.role IS NOT DISTINCT FROM r.role AND t.text IS NOT DISTINCT FROM r.text AS same
    FROM turns t FULL JOIN rejected r ON t.conv_id = r.conv_id AND t.i = r.i
), prompts AS (
    SELECT conv_id, coalesce(min(CASE WHEN NOT same THEN i END) - 1, max(i)) AS shared FROM compared GROUP BY conv_id
), both_sides AS (
    SELECT 'c' AS side, conv_id, i, role, text FROM turns UNION ALL SELECT 'r', * FROM rejected
), rendered AS (
    SELECT b.side, b.conv_id, b.i, b.role, p.shared, '<|im_start|>' || coalesce(role, '') || chr(10) AS head,
           replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' AS body
    FROM both_sides b JOIN prompts p ON p.conv_id = b.conv_id
), placed AS (
    SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY side, conv_id, i > shared ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM rendered
), texts AS (
    SELECT conv_id, max(shared) AS prompt_turns,
        coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= shared), '') AS prompt,
        coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 'c' AND i > shared), '') AS chosen_text,
        coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (WHERE side = 'r' AND i > shared), '') AS rejected_text,
        coalesce(string_agg((shift + length(head)) || ':' || (shift + length(head) + length(body)), ',' ORDER BY i)
                 FILTER (WHERE side = 'c' AND i > shared AND role = 'assistant'), '') AS chosen_mask,
        coalesce(string_agg((shift + length(head)) || ':' || (shift + length(head) + length(body)), ',' ORDER BY i)
                 FILTER (WHERE side = 'r' AND i > shared AND role = 'assistant'), '') AS rejected_mask
    FROM placed GROUP BY conv_id
)
SELECT * FROM texts
"""
