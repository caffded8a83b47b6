"""Preference formatting with DataFrame functions only.

`format_pairs` takes the turns of the chosen and of the rejected conversation of each pair.  Both are numbered by
position; the first position at which they differ (in role or text, or as one has ended) bounds their longest common
prefix, found by grouping turns on (pair, position).  A pair's turns are then gathered into its row, as they make the
texts of that row.  The prefix is rendered once as the prompt, the rest of each side as its completion, and the mask
lists the half-open ranges of the completion, in code points, on which loss is taken: the texts of assistant turns and
the end marks after them.

Turns are ordered by turn number, then role, then text; null turn numbers come first.  A null role or text is
empty.  Repeated turns stay; two turns of one side at one position count as the greater one.  A pair with one side only
has an empty prompt and an empty completion on the other side.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces

OPEN, BAR, END = "<|", "|>\n", "<|end|>\n"


def numbered(turns: DataFrame, key: str) -> DataFrame:
    """key, pos (from 0), last, role and text of each turn."""
    by = Window.partitionBy(key)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = turns.select(F.col(key), "turn", role.alias("role"), text.alias("text"))
    pos = F.row_number().over(by.orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    return turns.select(key, pos.alias("pos"), (F.count("*").over(by) - 1 == pos).alias("last"), "role", "text")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BAR), text, F.lit(END))


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row per pair from two frames of (key, pos, role, text)."""
    turns = chosen.select(key, "pos", "role", "text", F.lit(0).alias("side")).unionByName(rejected.select(key, "pos", "role", "text", F.lit(1).alias("side")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("role", "text")))
    met = turns.groupBy(key, "pos").agg(of(0).alias("c"), of(1).alias("r"))
    apart = ~F.col("c").eqNullSafe(F.col("r"))
    cut = met.groupBy(key).agg(
        F.coalesce(F.min(F.when(apart, F.col("pos"))), F.max("pos") + 1).alias("n_prompt"),
        F.array_sort(F.collect_list(F.struct("pos", "c", "r"))).alias("turns"),
    )

    def text_of(side: str, keep) -> Column:
        own = F.filter("turns", lambda t: t[side].isNotNull() & keep(t["pos"]))
        return F.array_join(F.transform(own, lambda t: rendered(t[side]["role"], t[side]["text"])), "")

    def mask_of(side: str) -> Column:
        own = F.filter("turns", lambda t: t[side].isNotNull() & (t["pos"] >= F.col("n_prompt")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            head = acc["at"] + F.length(t[side]["role"]) + len(OPEN) + len(BAR)
            end = head + F.length(t[side]["text"]) + len(END)
            span = F.array(F.concat_ws(":", head.cast("string"), end.cast("string")))
            return F.struct(end.alias("at"), F.when(t[side]["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(own, start, step, lambda acc: F.array_join(acc["spans"], ","))

    inside, after = lambda p: p < F.col("n_prompt"), lambda p: p >= F.col("n_prompt")
    turns_of = lambda side: F.size(F.filter("turns", lambda t: t[side].isNotNull())).cast("long")
    return cut.select(
        key,
        F.col("n_prompt").cast("long").alias("n_prompt_turns"),
        turns_of("c").alias("n_chosen_turns"),
        turns_of("r").alias("n_rejected_turns"),
        text_of("c", inside).alias("prompt"),
        text_of("c", after).alias("chosen"),
        text_of("r", after).alias("rejected"),
        mask_of("c").alias("chosen_mask"),
        mask_of("r").alias("rejected_mask"),
    )


def swapped_endings(turns: DataFrame, ring_size: int = 512) -> DataFrame:
    """Rejected sides for a table without preferences: each conversation with the last turn of another one.

    Conversations stand in rings by the MD5 of their id; each takes the ending of the next in its ring.
    """
    ends = turns.where("last").select("conv_id", "role", "text")
    rings = pieces(turns.select("conv_id").distinct().count(), ring_size)
    key = F.md5(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary"))
    ends = ends.withColumn("key", key).withColumn("ring", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % rings)
    by = Window.partitionBy("ring").orderBy("key")
    first = F.first(F.struct("role", "text")).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.withColumn("next", F.coalesce(F.lead(F.struct("role", "text")).over(by), first))
    new = ends.select("conv_id", F.col("next.role").alias("new_role"), F.col("next.text").alias("new_text"))
    joined = turns.join(new, turns["conv_id"].eqNullSafe(new["conv_id"])).drop(new["conv_id"])
    return joined.select(
        "conv_id",
        "pos",
        F.when(F.col("last"), F.col("new_role")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("last"), F.col("new_text")).otherwise(F.col("text")).alias("text"),
    )


def op8_preference_formatting(conversations: DataFrame) -> DataFrame:
    turns = numbered(conversations, "conv_id")
    return format_pairs(turns, swapped_endings(turns), "conv_id")


def op8_sql(ring_size: int = 512) -> str:
    spell = "'<|' || {r} || '|>' || chr(10) || {t} || '<|end|>' || chr(10)"

    def mask(side: str) -> str:
        # ends[i] is the length of everything up to and with turn i
        return f"""coalesce(array_to_string(list_transform(list_filter(range(1, len({side}) + 1), lambda i: {side}[i].role = 'assistant'),
            lambda i: (list_sum(list_transform({side}[1:i], lambda x: length({spell.format(r="x.role", t="x.text")})))::BIGINT - length({side}[i].text) - 8)::VARCHAR || ':' ||
                 list_sum(list_transform({side}[1:i], lambda x: length({spell.format(r="x.role", t="x.text")})))::BIGINT::VARCHAR), ','), '')"""

    text = lambda side: f"coalesce(array_to_string(list_transform({side}, lambda x: {spell.format(r='x.role', t='x.text')}), ''), '')"
    return f"""
    WITH t AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
             coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
    n AS (SELECT *, pos = max(pos) OVER (PARTITION BY conv_id) AS last FROM t),
    e AS (SELECT conv_id, role, text, md5(coalesce(conv_id::VARCHAR, '')) AS key FROM n WHERE last),
    g AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / {ring_size}.0))::BIGINT FROM e) AS ring FROM e),
    s AS (SELECT conv_id, coalesce(lead({{'role': role, 'text': text}}) OVER (PARTITION BY ring ORDER BY key),
            first({{'role': role, 'text': text}}) OVER (PARTITION BY ring ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx FROM g),
    j AS (SELECT n.conv_id, n.pos, {{'role': n.role, 'text': n.text}} AS c,
            CASE WHEN n.last THEN s.nx ELSE {{'role': n.role, 'text': n.text}} END AS r
          FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
    k AS (SELECT conv_id, coalesce(min(pos) FILTER (WHERE c IS DISTINCT FROM r), max(pos) + 1)::BIGINT AS np, count(*) AS total,
            list(c ORDER BY pos) AS cs, list(r ORDER BY pos) AS rs FROM j GROUP BY conv_id),
    d AS (SELECT conv_id, np, total, cs[1:np] AS p, cs[np + 1:] AS c, rs[np + 1:] AS r FROM k)
    SELECT conv_id, np AS n_prompt_turns, total AS n_chosen_turns, total AS n_rejected_turns, {text("p")} AS prompt,
           {text("c")} AS chosen, {text("r")} AS rejected, {mask("c")} AS chosen_mask, {mask("r")} AS rejected_mask FROM d"""
