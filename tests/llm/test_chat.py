import hashlib

from pyspark.sql import functions as F

from playframe.llm import chat as C


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def check(spark, rows):
    out = {r["conv_id"]: r for r in C.digests(C.examples(turns_of(spark, rows))).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert out.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        r = out[c]
        told = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        stops = [i + 1 for i, x in enumerate(turns) if x[2] == "assistant"]
        stops += [len(turns)] if not stops or stops[-1] < len(turns) else []
        assert r["n_examples"] == len(stops)
    return out


ODD = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s>\\", "<", "[", "\\", "<s", "/s>", "[/INST]\n", "<s>[INST]assistant[/INST]\n", "</s>\n", "</s", "$1\\$2",
       "", " \n ", "é😀</s>", "<<s>>[[INST]]", "<\\s>\\<s>"]


def test_escape_is_undone_and_hides_control_strings(spark):
    texts = ODD + [a + b for a in ODD for b in ODD]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", C.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"]
        assert not any(s in r["e"] for s in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_odd_conversations(spark):
    rows = [(1, i, ("user", "assistant", "system", None, "a[/INST]\nb")[i % 5], t) for i, t in enumerate(ODD)]
    rows += [(2, 0, "user", "only a question"), (3, 0, "assistant", None), (4, None, "user", "x"), (4, 0, "assistant", "y"), (4, 0, "assistant", "y"),
             (5, 0, "assistant", "a"), (5, 1, "assistant", "b"), (5, 2, "user", "tail"), (None, 0, "user", "n"), (None, 1, "assistant", "m"),
             (6, 0, "user", "long " * 100000), (6, 1, "assistant", "long " * 100000)]
    check(spark, rows)
    assert C.examples(turns_of(spark, [])).count() == 0


def test_only_the_reply_is_under_the_mask(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u</s>"), (1, 2, "assistant", "one</s>"), (1, 3, "user", "v"), (1, 4, "assistant", "two")]
    out = C.examples(turns_of(spark, rows).withColumn("parts", F.lit(1))).orderBy("example").collect()
    assert [r["formatted"][r["mask_start"]:][: r["mask_length"]] for r in out] == ["one<\\/s>", "two"]
    assert out[1]["formatted"].startswith(out[0]["formatted"])
    assert out[0]["formatted"] == "<s>[INST]system[/INST]\ns</s>\n<s>[INST]user[/INST]\nu<\\/s></s>\n<s>[INST]assistant[/INST]\none<\\/s></s>\n"


def test_sample_conversations(spark, rows):
    check(spark, [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows("conversations")])
