"""Reply trees to training conversations.

Method. Messages are nodes with a parent. Root-to-leaf paths are enumerated by iterated self-joins
that double the reach of each step (a node joins its 1st, 2nd, 4th, ... ancestor), so a thread of n
turns takes log2(n) joins. Branches are ranked by the sum of their messages' scores, the best ones
are kept, and each is formatted as one conversation.

The template marks a turn as <|turn|>role, a line feed, the text, <|end|> and a line feed. Inside
roles and texts the escape character is doubled and every control string gets one after its first character, so
no control string is left in them and the original can be read back. Text under the loss mask is
what assistants say; loss spans are code point offsets into the formatted string.

Native: DataFrame functions only. Cycles never reach a root and have no path.

Defined cases. Null texts and roles are empty. A message whose parent is missing from its
conversation is a root. Rows that repeat a turn follow each other by role and text. A null
conversation id is a conversation of its own. An empty table gives an empty result. Other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

TURN, END = "<|turn|>", "<|end|>"
#: Strings that steer common chat templates.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
ESC = "\\"
_LINE = "<" + ESC + "~"  # a line feed inside a role


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESC), F.lit(ESC * 2))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESC + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in reversed(CONTROL):
        out = F.replace(out, F.lit(c[0] + ESC + c[1:]), F.lit(c))
    return F.replace(out, F.lit(ESC * 2), F.lit(ESC))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(_LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(_LINE), F.lit("\n")))


def linear_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of a table without parents: each row answers the one before it, by turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order).cast("long")
    return rows.select("conv_id", at.alias("node"), F.when(at > 1, at - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, dist): every node on the path from each leaf up to its root, dist steps above the leaf."""
    ids = stash(nodes.select("conv_id", "node", "parent"), "trees")
    up = ids.alias("a").join(ids.alias("b"), F.expr("a.conv_id <=> b.conv_id and a.parent = b.node"), "left")
    jump = stash(up.select("a.conv_id", "a.node", F.col("b.node").alias("to")), "trees")
    heard = jump.filter("to is not null").select("conv_id", F.col("to").alias("node")).distinct()
    path = jump.alias("a").join(heard.alias("h"), F.expr("a.conv_id <=> h.conv_id and a.node = h.node"), "left_anti").select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    longest = ids.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < longest:
        live = jump.filter("to is not null")
        more = path.alias("p").join(live.alias("j"), F.expr("p.conv_id <=> j.conv_id and p.node = j.node")).select("p.conv_id", "p.leaf", F.col("j.to").alias("node"), (F.col("p.dist") + step).alias("dist"))
        path = stash(path.unionByName(more), "trees")
        step *= 2
        if step < longest:
            jump = stash(live.alias("a").join(live.alias("b"), F.expr("a.conv_id <=> b.conv_id and a.to = b.node")).select("a.conv_id", "a.node", F.col("b.to").alias("to")), "trees")
            if jump.isEmpty():
                break
    return path


def format_trees(nodes: DataFrame, best: int = 1) -> DataFrame:
    """nodes: conv_id, node, parent, role, text, score. For each conversation its best paths:
    conv_id, rank, leaf, n_turns, score, formatted, loss_spans (array of start, length)."""
    nodes = nodes.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    path = root_to_leaf_paths(nodes)
    scored = path.alias("p").join(nodes.select("conv_id", "node", "score").alias("n"), F.expr("p.conv_id <=> n.conv_id and p.node = n.node")).groupBy("p.conv_id", "p.leaf").agg(F.sum("n.score").alias("score"))
    first = Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= best)
    said = path.alias("p").join(chosen.alias("c"), F.expr("p.conv_id <=> c.conv_id and p.leaf = c.leaf")).select("p.conv_id", "p.leaf", "p.node", "p.dist", "c.rank", "c.score")
    said = said.alias("p").join(nodes.drop("score", "parent").alias("n"), F.expr("p.conv_id <=> n.conv_id and p.node = n.node"))
    head = F.concat(F.lit(TURN), escape_role(F.col("n.role")), F.lit("\n"))
    body = escape(F.col("n.text"))
    turn = F.struct((-F.col("p.dist")).alias("at"), head.alias("head"), body.alias("body"), (F.col("n.role") == "assistant").alias("loss"))
    whole = said.groupBy("p.conv_id", "p.leaf", "p.rank", "p.score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    tail = END + "\n"
    whole = whole.withColumn("formatted", F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail)))))
    # Offsets by a running sum over the turns' lengths.
    lengths = F.transform("turns", lambda t: F.struct(F.char_length(t["head"]).alias("h"), F.char_length(t["body"]).alias("b"), t["loss"].alias("loss")))
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc, t):
        span = F.struct((acc["at"] + t["h"]).cast("int").alias("start"), t["b"].cast("int").alias("length"))
        return F.struct((acc["at"] + t["h"] + t["b"] + len(tail)).cast("int").alias("at"), F.when(t["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(lengths, zero, add, lambda acc: acc["spans"])
    return whole.select("conv_id", "rank", "leaf", F.size("turns").cast("long").alias("n_turns"), "score", "formatted", spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x: F.length(x) > 0)

    def turn(block):
        cut_at = F.instr(block, "\n")
        text = F.substr(block, cut_at + 1, F.char_length(block) - cut_at - len(END) - 1)
        return F.struct(unescape_role(F.substr(block, F.lit(1), cut_at - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, turn)


def formatted_digest(rows: DataFrame) -> DataFrame:
    """The contract's row per conversation, read back from the formatted output."""
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    table = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(extra)
    made = format_trees(linear_nodes(table))
    turns = F.concat_ws("", F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))))
    made = made.select("*", turns.alias("turns"), loss.alias("loss"))
    return made.select("conv_id", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


#: DuckDB SQL for formatted_digest but for formatted_chars, which is that of the template above.
def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


DIGEST_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(TURN) + len(END) + 2} + length(replace({_sql_escape('role')}, chr(10), '{_LINE}')) + length({_sql_escape('text')})) as bigint) as formatted_chars
from t group by conv_id
"""
