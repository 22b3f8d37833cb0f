"""Chat formatting: the best branches of reply trees, each as one conversation.

Rows are messages (conv_id, node, parent, score, role, text). Root-to-leaf paths are found by
iterative self-joins that double: each message knows its ancestor 2**k replies up, the distance and
the sum of scores on the way, and a round joins those that know no root yet with all on that ancestor. Leaves are
ranked by the sum of their path; the chosen ones mark their ancestors through the same tables, from
the longest jumps to the shortest. So a path of n messages takes log2(n) rounds, and only chosen
paths are ever written out.

A turn is written as

    <|turn role="ROLE" train="0 or 1"|>
    TEXT
    <|end|>

with & and < of the text (& < > " of the role) as entities, so that no text can hold a marker and
parse() gives back every text exactly. train="1" marks what the loss is taken of, the texts of TRAINED
roles; loss_spans has the same as code point offsets of the escaped texts.

Defined cases: null text or role is empty; a parent that does not exist makes a root; messages in a
cycle lead to no root and are left out; ties between branches go to the longer one and then to the
smaller leaf; equal messages are separate ones; null conversation ids form one conversation; other
columns are ignored. A formatted conversation is one string, so it must fit one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stash, read

TRAINED = ("assistant",)
TURN, TRAIN, OPEN, CLOSE = '<|turn role="', '" train="', '"|>\n', "\n<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, branch, node, depth) of the messages on each conversation's best branches.

    messages: conv_id, node, parent, score; node is unique in its conversation.
    """
    stash = Stash(messages.sparkSession, "chat")
    key = F.col("conv_id").eqNullSafe
    up = messages.select("conv_id", "node", F.col("parent").alias("anc"), F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("total"))
    have = messages.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"))
    up = up.join(have, key(F.col("_c")) & (F.col("anc") == F.col("_n")), "left").select("conv_id", "node", F.col("_n").alias("anc"), "total", F.when(F.col("_n").isNotNull(), 1).otherwise(0).cast("long").alias("dist"))
    # messages that know their root are done; only the others, climbing, take part in a round
    up = stash.keep(up)
    done, climbing = [up.filter(F.col("anc").isNull())], up.filter(F.col("anc").isNotNull())
    jumps = []
    rounds = 1 + math.ceil(math.log2(max(2, up.count())))
    for _ in range(rounds):
        if climbing.isEmpty():
            break
        jumps.append(climbing.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "anc"))
        far = reduce(DataFrame.unionByName, done, climbing).select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.col("anc").alias("_a"), F.col("total").alias("_t"), F.col("dist").alias("_d"))
        up = climbing.join(far, key(F.col("_c")) & (F.col("anc") == F.col("_n"))).select("conv_id", "node", F.col("_a").alias("anc"), (F.col("total") + F.col("_t")).alias("total"), (F.col("dist") + F.col("_d")).alias("dist"))
        up = stash.keep(up)
        done.append(up.filter(F.col("anc").isNull()))
        climbing = up.filter(F.col("anc").isNotNull())
    up = reduce(DataFrame.unionByName, done).select("conv_id", "node", "total", F.col("dist").alias("depth"))
    answered = messages.filter(F.col("parent").isNotNull()).select(F.col("conv_id").alias("_c"), F.col("parent").alias("_p")).distinct()
    leaves = up.join(answered, key(F.col("_c")) & (F.col("node") == F.col("_p")), "left_anti")
    best = W.partitionBy("conv_id").orderBy(F.desc("total"), F.desc("depth"), "node")
    if branches == 1:
        top = leaves.groupBy("conv_id").agg(F.min(F.struct((-F.col("total")).alias("t"), (-F.col("depth")).alias("d"), F.col("node").alias("n"))).alias("m"))
        chosen = top.select("conv_id", F.lit(1).alias("branch"), F.col("m.n").alias("node"))
    else:
        chosen = leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= branches).select("conv_id", "branch", "node")
    on = stash.keep(chosen)
    for j in reversed(jumps):
        above = on.join(j, key(F.col("_c")) & (F.col("node") == F.col("_n"))).select("conv_id", "branch", F.col("anc").alias("node"))
        on = on.unionByName(stash.keep(above))
    depth = up.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "depth")
    return on.join(depth, key(F.col("_c")) & (F.col("node") == F.col("_n"))).select("conv_id", "branch", "node", "depth")


def formatted(messages: DataFrame, branches: int = 1, trained=TRAINED) -> DataFrame:
    """(conv_id, branch, n_turns, formatted, loss_spans) of each conversation's best branches."""
    chosen = paths(messages, branches)
    rows = messages.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = chosen.join(rows, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")))
    loss = F.col("role").isin(*trained)
    head = F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit(TRAIN), loss.cast("int").cast("string"), F.lit(OPEN))
    body = escape(F.col("text"))
    rows = rows.select("conv_id", "branch", "depth", F.concat(head, body, F.lit(CLOSE)).alias("turn"), F.length(head).alias("skip"), F.length(body).alias("chars"), loss.alias("loss"))
    whole = rows.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "skip", "chars", "loss"))).alias("turns"))

    def span(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["skip"]
        one = F.when(x["loss"], F.array(F.struct(s.alias("start"), (s + x["chars"]).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((acc["at"] + F.length(x["turn"])).alias("at"), F.concat(acc["out"], one).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return whole.select("conv_id", "branch", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), F.aggregate("turns", zero, span, lambda a: a["out"]).alias("loss_spans"))


def parse(text: Column) -> Column:
    """A formatted conversation to array<struct<role, loss, text>>."""
    parts = F.filter(F.split(text, r"\<\|turn role=\"", -1), lambda x, i: i > 0)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, OPEN, 1)
        body = F.substring(p, F.length(head) + len(OPEN) + 1, F.length(p) - F.length(head) - len(OPEN) - len(CLOSE))
        return F.struct(_unescape_role(F.substring_index(head, TRAIN, 1)).alias("role"), (F.substring_index(head, TRAIN, -1) == "1").alias("loss"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def chains(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: each turn answers the one before it."""
    node = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return conversations.select("conv_id", "role", "text", node.alias("node")).select("*", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))


SAID = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAID).alias("text"))
    messages = Stash(spark, "chains").keep(chains(rows.unionByName(own)))
    back = formatted(messages).select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}'),
long AS (SELECT *, {len(TURN + TRAIN + OPEN + CLOSE) + 1} + length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', ''))) + length(role)
    + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(replace(role, '<', ''), '>', ''))) + 5 * (length(role) - length(replace(role, '"', ''))) AS chars FROM said),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM long GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""
