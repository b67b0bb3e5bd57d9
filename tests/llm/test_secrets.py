import random
import re
import time

from ledgerloom.llm import secrets
from ledgerloom.llm.secrets import BASE, Rule
from ledgerloom.sources.scratch import new_path, stored
from pyspark.sql import functions as F


def brute(text):
    kinds = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
    out = [(m.start(), i, k, m.end()) for i, (k, (p, g, n)) in enumerate(kinds.items()) for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= n]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_spans_against_brute_force(spark):
    rnd = random.Random(5)
    parts = ["token", "SECRET", "apikey", "api_key", "=", ": ", '"', "abc", "abcdef012", "AKIA" + "B2" * 9, "AKIA", "0123456789abcdef" * 2, " ", "é𝒳", "\n", "f"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(20))) for _ in range(300)] + ["secret=token: abcdefgh", "x" * 50_000 + " token=abcdefg"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("blob", F.lit("clash"))
    ledger = stored(secrets.scan(secrets.blobs_of(docs, "text"), None, BASE), "ledger")
    got = {r.doc_id: r.s for r in secrets.findings(docs, "text", ledger, BASE).select("doc_id", secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)} and any(got.values())


def test_only_unseen_pairs_are_scanned(spark):
    one = spark.createDataFrame([("a", 1, "token=abcdefg"), ("b", 1, "token=abcdefg"), ("c", 1, None), (None, 2, "")], "path string, version int, text string")
    ledger = stored(secrets.scan(secrets.blobs_of(one, "text"), None), "ledger")
    assert ledger.count() == 2  # equal contents are one blob
    assert secrets.scan(secrets.blobs_of(one, "text"), ledger).count() == 0
    two = one.unionByName(spark.createDataFrame([("a", 2, "AKIA" + "X" * 16)], one.schema))
    new = secrets.scan(secrets.blobs_of(two, "text"), ledger)
    assert new.count() == 1
    whole = stored(ledger.unionByName(new), "ledger")
    got = sorted((r.path or "", r.version, [s.kind for s in r.spans]) for r in secrets.findings(two, "text", whole).collect())
    assert got == [("", 2, []), ("a", 1, ["assign"]), ("a", 2, ["access"]), ("b", 1, ["assign"]), ("c", 1, [])]
    # A new version of one rule is scanned alone, and findings of its old version no longer count.
    rules = (Rule("assign", 2, "(tok)(en)", 2, 1), *secrets.RULES[1:])
    again = secrets.scan(secrets.blobs_of(two, "text"), whole, rules)
    assert {tuple(r.rules) for r in again.collect()} == {("assign@2",)}
    got = secrets.findings(two, "text", stored(whole.unionByName(again), "ledger"), rules).where("path = 'b'").first()
    assert [(s.start, s.stop) for s in got.spans] == [(0, 5)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.findings(none, "text", secrets.empty_ledger(spark)).count() == 0
    assert secrets.scan(secrets.blobs_of(none, "text"), secrets.empty_ledger(spark)).count() == 0


def test_deliveries_into_a_stored_ledger(spark):
    path = new_path(spark, "ledger")
    one = spark.createDataFrame([("a", "token=abcdefg"), ("b", ""), ("c", None)], "path string, text string")
    assert secrets.deliver(path, one, "text").count() == 2
    assert secrets.deliver(path, one, "text").count() == 2  # again: nothing is unseen
    two = one.unionByName(spark.createDataFrame([("d", "AKIA" + "X" * 16), ("e", "token=abcdefg")], one.schema))
    ledger = secrets.deliver(path, two, "text")
    assert ledger.count() == 3
    newer = (Rule("assign", 2, "(tok)(en)", 2, 1), *secrets.RULES[1:])
    ledger = secrets.deliver(path, two, "text", newer)
    assert ledger.count() == 6 and ledger.where("array_contains(rules, 'assign@2') AND size(rules) = 1").count() == 3
    got = {r.path: [(s.kind, s.start, s.stop) for s in r.spans] for r in secrets.findings(two, "text", ledger, newer).collect()}
    assert got == {"a": [("assign", 0, 5)], "b": [], "c": [], "d": [("access", 0, 20)], "e": [("assign", 0, 5)]}


def test_very_many_hits_in_one_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "é token=abcdefg x=1" * n)], "doc_id long, text string")
    start = time.time()
    ledger = stored(secrets.scan(secrets.blobs_of(docs, "text"), secrets.empty_ledger(spark), BASE), "ledger")
    found = ledger.first().spans
    assert time.time() - start < 60 and len(found) == n
    assert all((s.start, s.stop) == (2 + 19 * i, 15 + 19 * i) for i, s in enumerate(found))
