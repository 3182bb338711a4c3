"""Chat formatting by DataFrame functions alone: reply trees, ranked root-to-leaf paths, templates and loss masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starfold.llm.common import load, written

START, OPEN, SHUT, END = "<s>", "<|", "|>\n", "</s>\n"
#: What texts and roles may not hold unescaped, and how it is written; the backslash is first.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))


def escape(c: Column) -> Column:
    """No control string is left: each holds one of the escaped characters."""
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    """A backslash is always followed by its letter, so the order of these is safe with the backslash last."""
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def _key(*cols: str) -> Column:
    """One non-null key of nullable columns."""
    return F.to_json(F.struct(*(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(cols))), {"ignoreNullFields": "false"})


def chosen_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` root-to-leaf paths of each tree by total score: path, tree_id, pos, role, text.

    ``nodes`` has tree_id, node_id, parent_id, role, text and score.  A node is a
    root if its parent_id is null or is no node of its tree.  Null scores count 0.
    Rows that repeat a node id are one node, its least row.  Ties between paths
    go to the smaller leaf id.  Chains that close on themselves have no root and
    give no path.  Joins of the table with itself double the known distance each
    time, so a tree of depth d takes log2(d) of them; only ids and sums take part,
    and only the paths that were chosen are spread out.
    """
    rows = nodes.groupBy("tree_id", "node_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("n"))
    rows = rows.select(_key("tree_id").alias("t"), _key("tree_id", "node_id").alias("id"), "tree_id", "node_id", F.when(F.col("n.parent_id").isNotNull(), F.to_json(F.struct(F.col("tree_id").cast("string").alias("k0"), F.col("n.parent_id").cast("string").alias("k1")), {"ignoreNullFields": "false"})).alias("up"), F.col("n.role").alias("role"), F.col("n.text").alias("text"), F.coalesce("n.score", F.lit(0.0)).cast("double").alias("score"))
    rows = written(rows, "chat-nodes")
    known = rows.select(F.col("id").alias("up"))
    ups = rows.select("id", "up").join(known, "up", "left_semi")
    above = ups.select(F.col("up").alias("id")).distinct().withColumn("inner", F.lit(True))
    # state: id, up (an ancestor at the present distance, null beyond the root), whole (the scores from id to below up)
    state = rows.select("t", "id", "node_id", "score").join(ups, "id", "left").join(above, "id", "left").select("t", "id", "node_id", "up", F.col("score").alias("whole"), F.col("inner").isNull().alias("leaf"))
    jumps, ended, distance, limit = [], [], 1, rows.count()
    new = state = written(state, "chat-state")
    while True:
        ended.append(new.filter("leaf and up is null"))
        active = new.filter("up is not null")
        jumps.append((distance, active.select("id", "up")))
        if distance > limit or active.isEmpty():
            break
        upper = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("whole").alias("whole2"))
        new = written(active.join(upper, "up").select("t", "id", "node_id", F.col("up2").alias("up"), (F.col("whole") + F.col("whole2")).alias("whole"), "leaf"), "chat-jumps")
        # only trees that still have a way to go are carried on
        going = new.filter("up is not null").select("t").distinct()
        state = written(new.unionByName(state.filter("up is null")).join(going, "t", "left_semi"), "chat-state")
        distance *= 2
    leaves = reduce(DataFrame.unionByName, ended)
    ranked = leaves.withColumn("rn", F.row_number().over(Window.partitionBy("t").orderBy(F.col("whole").desc(), "node_id")))
    paths = ranked.filter(F.col("rn") <= top).select(F.col("id").alias("path"), "id", F.lit(0).cast("long").alias("dist"))
    for step, jump in jumps:
        further = paths.join(jump, "id").select("path", F.col("up").alias("id"), (F.col("dist") + step).alias("dist"))
        paths = written(paths.unionByName(further), "chat-paths") if step > 1 else paths.unionByName(further)
    return paths.join(rows, "id").select("path", "tree_id", (-F.col("dist")).alias("pos"), "role", "text")


def format_paths(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: tree_id, path, formatted, loss_spans (byte start and length in ``formatted`` of each text of the role ``learn``).

    Null roles and texts count as empty.  A conversation is one text, so its
    rows meet in one task; that is the size of the output row itself.  Other
    columns are not carried; an empty table gives none.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = paths.select("path", "tree_id", "pos", F.concat(F.lit(OPEN), role, F.lit(SHUT)).alias("head"), text.alias("body"), (F.coalesce("role", F.lit("")) == learn).alias("learn"))
    turns = turns.withColumn("end", F.sum(F.octet_length("head") + F.octet_length("body") + len(END)).over(Window.partitionBy("path").orderBy("pos")).cast("long") + len(START))
    turns = turns.withColumn("at", F.col("end") - len(END) - F.octet_length("body"))
    one = turns.groupBy("path").agg(F.first("tree_id").alias("tree_id"), F.array_sort(F.collect_list(F.struct("pos", "head", "body", "learn", "at"))).alias("turns"))
    return one.select(
        "tree_id", "path",
        F.concat(F.lit(START), F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")).alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["learn"]), lambda x: F.struct(x["at"].alias("start"), F.octet_length(x["body"]).cast("long").alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """With turns (role, text), loss_text: what the text and the loss mask hold."""
    parts = F.slice(F.split(F.substring(F.col("formatted"), len(START) + 1, 1 << 30), END), 1, F.greatest(F.size(F.split("formatted", END)) - 1, F.lit(0)))
    turns = F.transform(parts, lambda x: F.struct(unescape(F.substring_index(x, SHUT, 1).substr(F.lit(len(OPEN) + 1), F.length(x))).alias("role"), unescape(x.substr(F.length(F.substring_index(x, SHUT, 1)) + len(SHUT) + 1, F.length(x))).alias("text")))
    raw = F.col("formatted").cast("binary")
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(raw, s["start"].cast("int") + 1, s["length"].cast("int")).cast("string")))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})


def linear_trees(conversations: DataFrame) -> DataFrame:
    """A chain for each conversation: rows by turn, those of one turn by role, then text; nulls come first.

    Rows that repeat a turn, or are equal, all stay.  Other columns are not
    carried; an empty table gives none.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.withColumn("node_id", F.row_number().over(order).cast("long")).select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"))


def op2_chat(spark, sf_dir: str) -> DataFrame:
    said = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = read_back(format_paths(chosen_paths(linear_trees(said.unionByName(more)))))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SAFE = r"replace(replace(replace(replace({c}, '\', '\e'), '<', '\l'), '[', '\b'), '|', '\p')"
OP2_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(10 + length({_SAFE.format(c="role")}) + length({_SAFE.format(c="text")})))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""
