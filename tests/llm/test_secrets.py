import hashlib
import re

from pyspark.sql import functions as F

from playframe.llm import secrets as S

ASSIGN = re.compile(r'''((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])'''
                    r'''|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''')


def brute(text):
    t, out = text or "", []
    out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 16]
    return sorted(out)


def base(found):
    return [(f["start"], f["rank"], f["kind"], f["end"]) for f in found if f["kind"] in ("assign", "access", "hex")]


ODD = [
    None, "", "token=short token = abcdefghijklm", "token:secret:abcdefghijkl", 'Password": "abcdefghijkl+/_.=-" x', "ſecret=abcdefghijklmn",
    "api-key=abcdefghijklmn apikey:abcdefghijklmn API_KEY = 'abcdefghijklmn'", "AKIA" + "A1" * 7, "AKIAAKIA" + "B" * 10, "AKIA" + "A" * 13,
    "0123456789abcdef", "0123456789abcde", "x0123456789abcdef0g", "😀 token=0123456789abcdef0123 é 0123456789abcdef", "token=" + "f" * 100000,
    "deadbeefdeadbeef " * 300, "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----", "eyJabcdefgh1.abcdefgh2.abcdefgh3",
    "passwdpassword=abcdefghijklm", "token==abcdefghijkl", "secret  :   'aaaaaaaaaaaa'",
]


def test_base_spans(docs_of, spark, sf):
    for docs in (docs_of([(i, t, None) for i, t in enumerate(ODD)] + [(0, ODD[4], "x")] * 2), spark.read.parquet(f"{sf}/documents.parquet")):
        out = S.findings(docs).collect()
        assert len(out) == docs.count()
        for r in out:
            assert base(r["findings"]) == brute(r["text"]), r["doc_id"]


def test_extra_rules_and_joined(docs_of):
    out = S.findings(docs_of([(1, ODD[16], None), (2, ODD[17], None), (3, "token=0123456789abcdef", None)])).select(
        "doc_id", S.joined(F.col("findings")).alias("j")).collect()
    assert {r["doc_id"]: r["j"] for r in out} == {1: "github:0:40,hex:4:40,pem:41:72", 2: "jwt:0:32", 3: "assign:0:22,hex:6:22"}


def test_ledger_scans_only_what_is_new(spark, docs_of):
    first = docs_of([(i, t, None) for i, t in enumerate(ODD)])
    ledger = S.scan(first)
    blobs = {hashlib.sha256((t or "").encode()).hexdigest() for t in ODD}
    assert {(r["blob"], r["version"]) for r in ledger.collect()} == {(b, v) for b in blobs for v in S.VERSIONS}
    second = docs_of([(50, ODD[4], None), (51, "token=newnewnewnew1", None)])
    added = S.scan(second, ledger).collect()
    assert {r["blob"] for r in added} == {hashlib.sha256(b"token=newnewnewnew1").hexdigest()} and len(added) == len(S.VERSIONS)
    part = ledger.filter(F.col("version") == "base-1")
    assert {r["version"] for r in S.scan(first, part).collect()} == {"extra-1"}
    want = sorted(map(str, S.findings(first.union(second)).collect()))
    for known in (ledger, part, ledger.limit(0), ledger.union(ledger)):
        assert sorted(map(str, S.findings(first.union(second), known).collect())) == want
    # a forged ledger row shows that known pairs are not scanned again
    forged = ledger.withColumn("findings", F.array().cast(S.FINDING))
    assert all(not r["findings"] for r in S.findings(first, forged).collect())


def test_history_with_several_versions_and_other_columns(docs_of):
    history = docs_of([(1, "token=aaaaaaaaaaaa", "v1"), (1, "clean", "v2"), (2, "token=aaaaaaaaaaaa", "v9")]).withColumns(
        {"blob": F.lit("b"), "kind": F.lit(1), "start": F.lit(2), "version": F.lit("z")})
    out = S.findings(history)
    assert out.columns == [*history.columns, "findings"]
    assert sorted((r["doc_id"], r["lang"], len(r["findings"]), r["blob"]) for r in out.collect()) == [(1, "v1", 1, "b"), (1, "v2", 0, "b"), (2, "v9", 1, "b")]
    assert S.findings(docs_of([])).count() == 0 and S.scan(docs_of([])).count() == 0 and S.redact(docs_of([])).count() == 0


def test_redaction(docs_of):
    def plain(text):
        if text is None:
            return None
        spans, out, at = [], "", 0
        for s, _, _, e in brute(text):
            if spans and s < spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        for s, e in spans:
            out, at = out + text[at:s] + S.MARK, e
        return out + text[at:]

    use = [t for t in ODD if not t or not re.search("ghp_|eyJ", t)]
    docs = docs_of([(i, t, None) for i, t in enumerate(use)])
    out = S.redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r["text"] == plain(use[r["doc_id"]])
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_a_kept_ledger_is_read_and_grows(spark, docs_of, tmp_path):
    docs = docs_of([(i, t, None) for i, t in enumerate(ODD)] + [(900 + i, ODD[2], None) for i in range(400)])
    held = S.Ledger(spark, str(tmp_path / "ledger"))
    rows = held.update(docs)
    blobs = {hashlib.sha256((t or "").encode()).hexdigest() for t in ODD}
    assert sorted((r["blob"], r["version"]) for r in rows.collect()) == sorted((b, v) for b in blobs for v in S.VERSIONS)
    want = sorted(map(str, S.findings(docs).collect()))
    assert sorted(map(str, S.findings(docs, rows, complete=True).collect())) == want
    assert sorted(map(str, S.redact(docs, rows).collect())) == sorted(map(str, S.redact(docs).collect()))
    assert held.update(docs).count() == rows.count()  # the second run adds no pair, so it scanned none
    assert held.update(docs_of([])).count() == rows.count()
    more = held.update(docs_of([(1, "token=newnewnewnew1", None), (2, ODD[4], None)]))
    assert more.count() == rows.count() + len(S.VERSIONS)
    spark.conf.set(S.KEPT, held.path)
    try:
        assert S.Ledger(spark).rows().count() == more.count()
    finally:
        spark.conf.unset(S.KEPT)
    assert S.Ledger(spark).rows().count() == 0
