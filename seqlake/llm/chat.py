r"""Reply trees to training conversations: paths from root to leaf, branches by score, one formatted text a chosen path.

messages: tree, id, parent, role, text, score. A message whose parent is null or not in its tree is a root. Links are followed by
pointer doubling: round k is a self-join that takes every message 2^k steps up, so a path of n messages takes log2(n) rounds, and
no round carries texts. Only the chosen branches' paths are enumerated.

Format: user turns stand in `[INST] ` and ` [/INST]`, system turns in `<<SYS>> ` and ` <</SYS>>`, assistant turns in `<s>` and
`</s>`, other roles in `[ROLE name] ` and ` [/ROLE]` with the name URL-encoded. In texts a backslash is doubled and a control
string gets a backslash after its first character; so no text holds one, and a backslash always stands for "take the next character
as it is". The loss mask is a list of spans (start, end; code points of the formatted text): those of assistant texts.

Defined results: null text and role are empty strings; a null score is 0; trees may be null (one tree); rows of equal tree and id
are one message, the least by (parent, role, text, score); messages on a cycle, or below one, have no root and are on no path;
equal branch scores rank by leaf id. An empty table has no paths. Other columns are not read. A path is one row of the result and
must fit one task, as any document must; a tree need not: nothing is grouped by tree but the best branches, which every task cuts
to `best` before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stage

#: Role -> what stands before and after its texts.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
CONTROL = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE ", "[/ROLE]")
_CONTROL = r"\[(?=/?INST\]|ROLE |/ROLE\])|<(?=</?SYS>>|/?s>)"
_TURN = r"(?s)\[INST\] .*? \[/INST\]|<<SYS>> .*? <</SYS>>|<s>.*?</s>|\[ROLE [^\]]*\] .*? \[/ROLE\]"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, of, other: Column) -> Column:
    out = F
    for name, marks in MARKS.items():
        out = out.when(role == name, of(marks))
    return out.otherwise(other)


def opening(role: Column) -> Column:
    return _by_role(role, lambda m: F.lit(m[0]), F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit(OTHER[1])))


def closing(role: Column) -> Column:
    return _by_role(role, lambda m: F.lit(m[1]), F.lit(OTHER[2]))


# ---------------------------------------------------------------- trees
def _met(left: DataFrame, right: DataFrame, at: str, how: str = "left") -> DataFrame:
    """left joined with right (_tree, _id, ...) on tree, null trees being equal, and left's column `at`."""
    return left.join(right, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col(at) == F.col("_id")), how)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def climbed(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(tables of (tree, id, up): up is 2^k steps above, rows only where there is one; (tree, id, n, total): messages and score from the
    root down to each). A round asks for the messages that have not reached their root yet, no others.

    links: tree, id, parent, score, one row a message."""
    there = links.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
    known = _met(links, there, "parent").select("tree", "id", F.col("_id").alias("up"), F.lit(1).cast("long").alias("n"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    known = stage(known, "links")
    live, done, hops, many = known.where("up is not null"), [known.where("up is null")], [], known.count()
    while not live.isEmpty() and 2 ** len(hops) <= many:  # beyond, a row that still goes up is on a cycle
        hops.append(live.select("tree", "id", "up"))
        above = _all([*done, live]).select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("far"), F.col("n").alias("more"), F.col("total").alias("rest"))
        further = _met(live, above, "up", "inner").select("tree", "id", F.col("far").alias("up"), (F.col("n") + F.col("more")).alias("n"), (F.col("total") + F.col("rest")).alias("total"))
        further = stage(further, "links")
        live = further.where("up is not null")
        done.append(further.where("up is null"))
    return hops, _all(done).select("tree", "id", "n", "total")


def best_branches(links: DataFrame, top: DataFrame, best: int | None) -> DataFrame:
    """(tree, leaf, n, score, rank) of the `best` leaves of each tree by mean score of their path; None: all, with a null rank."""
    inner = links.where("parent is not null").select(F.col("tree").alias("_tree"), F.col("parent").alias("_id")).distinct()
    leaf = _met(top, inner, "id", "left_anti").select("tree", F.col("id").alias("leaf"), "n", (F.col("total") / F.col("n")).alias("score"))
    if best is None:
        return leaf.withColumn("rank", F.lit(None).cast("int"))
    return leaf.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= best)


def branch_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, pos, id): the messages of every chosen branch, pos counted from its root."""
    links = messages.select("tree", "id", "parent", "score")
    hops, top = climbed(links)
    chosen = stage(best_branches(links, top, best), "branches")
    parts = [chosen.select("tree", "leaf", "rank", "score", "n", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("off"))]
    for k, hop in enumerate(hops):
        above = hop.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), "up")
        more = _met(_all(parts), above, "id", "inner").select("tree", "leaf", "rank", "score", "n", F.col("up").alias("id"), (F.col("off") + 2**k).alias("off"))
        parts.append(stage(more, "paths"))
    return _all(parts).select("tree", "leaf", "rank", "score", (F.col("n") - 1 - F.col("off")).alias("pos"), "id")


def one_of_each(messages: DataFrame) -> DataFrame:
    """Of rows with equal tree and id the least."""
    x = messages.select("tree", "id", F.struct("parent", "role", "text", "score").alias("m"))
    return x.groupBy("tree", "id").agg(F.min("m").alias("m")).select("tree", "id", "m.parent", "m.role", "m.text", "m.score")


def format_branches(messages: DataFrame, best: int | None = 1, unique: bool = False) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss): one conversation for each chosen branch. unique: no tree has two rows of one id."""
    messages = messages.select("tree", "id", "parent", "role", "text", "score")
    messages = messages if unique else stage(one_of_each(messages), "messages")
    path = branch_paths(messages, best)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = messages.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), role.alias("role"), opening(role).alias("before"), escaped(text).alias("body"), closing(role).alias("after"))
    x = _met(path, turn, "id", "inner")
    size = F.length("before") + F.length("body") + F.length("after")
    begin = F.sum(size.cast("long")).over(Window.partitionBy("tree", "leaf").orderBy("pos")) - size + F.length("before")
    x = x.select("tree", "leaf", "rank", "score", F.struct("pos", F.concat("before", "body", "after").alias("piece"), begin.alias("start"), (begin + F.length("body")).alias("end"), (F.col("role") == "assistant").alias("learned")).alias("t"))
    g = x.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.sort_array(F.collect_list("t")).alias("t"))
    loss = F.transform(F.filter("t", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return g.select("tree", "leaf", "rank", "score", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


# ---------------------------------------------------------------- reading back
def turns_of(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turn(piece: Column) -> Column:
        inside = lambda a, b: F.substring(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b))
        name = F.regexp_extract(piece, r"^\[ROLE ([^\]]*)\] ", 1)
        other = F.struct(F.url_decode(name).alias("role"), F.substring(piece, F.length(name) + len(OTHER[0] + OTHER[1]) + 1, F.length(piece) - F.length(name) - len("".join(OTHER))).alias("text"))
        out = F
        for role, (a, b) in MARKS.items():
            out = out.when(F.startswith(piece, F.lit(a)), F.struct(F.lit(role).alias("role"), inside(a, b).alias("text")))
        return out.otherwise(other)

    return F.transform(F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn), lambda t: F.struct(t["role"].alias("role"), unescaped(t["text"]).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    at = lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(loss, at), "")


# ---------------------------------------------------------------- conversations
EXTRA = "</s>[INST] ok [/INST]"


def as_tree(conversations: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text): a chain each, in order of turn, then role and text; a repeated row is a
    turn of its own."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    x = conversations.select("conv_id", "turn", "role", "text").withColumn("id", at)
    return x.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The digests of the contract, read back from the files that the formatted conversations are written to."""
    spark = conversations.sparkSession
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string")
    messages = stage(as_tree(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)), "messages")
    path = scratch(spark, "chats")
    format_branches(messages, unique=True).select(F.col("tree").alias("conv_id"), "leaf", "formatted", "loss").write.parquet(path)
    x = spark.read.parquet(path).withColumn("turns", turns_of(F.col("formatted"))).withColumn("learned", loss_text(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_COUNT = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROL))
ORACLE = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM conversations
  UNION ALL SELECT -7, t, s, '{EXTRA}', s, '{EXTRA}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, s)),
f AS (SELECT *, length(text) + {_COUNT} + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 7 ELSE 16 + length(role) END AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""
