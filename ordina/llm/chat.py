r"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by their parent. Paths from root to leaf are enumerated by iterated self-joins
that double their reach: after k rounds a node knows its ancestor 2**k steps up, its depth and the
sum of scores so far. Leaves are ranked by the score of their branch, and the chosen leaves' paths
are filled in by the same ancestor tables, from the farthest to the nearest, so that a path of n
messages takes log2(n) joins and n rows. Keys are (tree, node): a tree of any size is dealt out.

Template. A turn is ``<turn>role\ntext</turn>\n``. In roles and texts a backslash is written ``\b``
and ``<`` is written ``\l`` (in roles a line feed ``\n``), so that marks never occur inside of
texts; ``unescaped`` is the inverse. The loss mask is the list of ``segments``: the formatted text
in pieces, each with a flag; the texts of assistant turns, and nothing else, bear it.

Defined results
  null text or role   empty
  null conv_id        ``linear`` makes it a tree of its own, and ``query`` returns a null id
  null tree or node   on no path: a message needs both
  null score          0
  missing parent      the message is a root
  a cycle             has no root; its messages are on no path
  ties in score       the smaller leaf
  repeated rows       ``linear`` orders rows by turn, role, text and keeps each as a turn
  null turn           before all others
  very long text      formatted whole; a conversation is one row
  empty table         no rows
  extra columns       not read
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<turn>", "</turn>\n"


def escaped(text: Column, line_feeds: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_feeds else out


def unescaped(text: Column, line_feeds: bool = False) -> Column:
    # Every backslash begins a pair, so the pairs can be undone one kind after another.
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if line_feeds else text
    return F.replace(F.replace(out, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def linear(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> messages of trees that are chains, in order of turns."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    plain = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    numbered = plain.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per k: (tree, node, up), the ancestor 2**k steps up; and (tree, node, depth, total) of nodes under a root."""
    nodes = messages.select("tree", "node", "parent", "score")
    known = nodes.select("tree", F.col("node").alias("parent"))
    linked = nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent", "score")
    roots = nodes.join(linked.select("tree", "node"), ["tree", "node"], "left_anti").withColumn("parent", F.lit(None).cast("long"))
    state = common.written(
        linked.unionByName(roots.select(*linked.columns)).select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")),
        "ancestors",
    )
    most, tables = messages.count(), []
    while 1 << len(tables) <= most:
        above = state.where("up is not null")
        if above.isEmpty():
            break
        tables.append(above.select("tree", "node", "up"))
        next_ = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        state = common.written(
            state.join(next_, ["tree", "up"], "left").select(
                "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total")
            ),
            "ancestors",
        )
    return tables, state.where("up is null").select("tree", "node", "depth", "total")


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """Messages -> (tree, leaf, back, node) of each tree's best branches; back counts from the leaf."""
    tables, reach = ancestors(messages)
    parents = messages.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = reach.join(parents, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), "node"))
    found = leaves.withColumn("rank", rank).where(F.col("rank") <= best).select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("back"), "node")
    found = common.written(found, "paths")
    for k in range(len(tables) - 1, -1, -1):
        farther = found.join(tables[k], ["tree", "node"]).select("tree", "leaf", (F.col("back") + (1 << k)).alias("back"), F.col("up").alias("node"))
        found = common.written(found.unionByName(farther), "paths")  # else the plan doubles with each table
    return found


def formatted(messages: DataFrame, best: int = 1) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) -> (tree, leaf, formatted, segments)."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    messages = common.written(messages.select("tree", "node", "parent", *texts, F.coalesce("score", F.lit(0.0)).alias("score")), "messages")
    turns = paths(messages, best).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), True), F.lit("\n"))
    turn = F.struct((-F.col("back")).alias("at"), head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    inorder = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(piece(t["head"], F.lit(False)), piece(t["body"], t["loss"]), piece(F.lit(CLOSE), F.lit(False)))))
    return inorder.select("tree", "leaf", segments.alias("segments")).select("tree", "leaf", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parsed(text: Column) -> Column:
    """A formatted conversation -> its turns, array<struct<role, text>>."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        inside = F.substr(piece, F.lit(len(OPEN) + 1))
        role = F.substring_index(inside, "\n", 1)
        return F.struct(unescaped(role, True).alias("role"), unescaped(F.substr(inside, F.length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def under_loss(segments: Column) -> Column:
    return unescaped(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


PROBE = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    output = common.written(formatted(linear(rows.unionByName(probe))), "conversations")
    done = output.select("tree", "formatted", parsed(F.col("formatted")).alias("turns"), under_loss(F.col("segments")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.expr("cast(nullif(tree, '') as long)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n')) + length(replace(replace(text, '\', '\b'), '<', '\l')) + 15 AS n FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
