import hashlib

from pyspark.sql import functions as F

from sumline.llm.reply_trees import escape, format_trees, formatted_digest, linear_nodes, read_turns, unescape


def test_escape_round_trip(spark):
    texts = ["", "\\", "<|", "<\\|", "<\\\\|", "</s>[INST]", "<<SYS>>x<</SYS>>", "a\\\\[INST]\\", "<<|end|>", "[/INST", "<|turn|>user\nx<|end|>\n", "<\\~", "é\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", unescape(F.col("e")).alias("u")).collect():
        assert r.t == r.u and "<|" not in r.e and "</s>" not in r.e and "[INST]" not in r.e


def test_digest_by_hand(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|end|>\n<|turn|>user\nb"), (1, 2, "user", None), (1, 3, "assistant", "c\\"), (2, 0, "sys\ntem", ""), (2, 5, "assistant", "é"), (2, 5, "assistant", "é"), (3, 0, None, "x"), (None, 0, "user", "q")]
    rows += [(4, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit(1)).withColumn("node", F.lit(1))
    got = {r.conv_id: r for r in formatted_digest(df).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        mine = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        whole = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= len(whole)
    assert len(got) == 6
    assert len(formatted_digest(df.filter("false")).collect()) == 1


def test_branches(spark):
    nodes = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", 0.0), (1, 5, 3, "user", "best", 1.0), (1, 6, 2, "user", "late", 0.5), (2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0)]
    df = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    out = format_trees(df, best=2).select("conv_id", "rank", F.transform(read_turns(F.col("formatted")), lambda t: t["text"]).alias("texts"), "loss_spans", "formatted").orderBy("conv_id", "rank").collect()
    assert [(r.conv_id, r["rank"], r.texts) for r in out] == [(1, 1, ["root", "good", "best"]), (1, 2, ["root", "good", "more"]), (2, 1, ["orphan"])]
    s = out[0].loss_spans[0]
    assert out[0].formatted[s.start : s.start + s.length] == "good"


def test_linear_nodes(spark):
    df = spark.createDataFrame([(1, 3, "u", "x"), (1, 1, "u", "y")], "conv_id long, turn long, role string, text string")
    assert sorted((r.node, r.parent, r.text) for r in linear_nodes(df).collect()) == [(1, None, "y"), (2, 1, "x")]
