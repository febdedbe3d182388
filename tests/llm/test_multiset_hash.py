import hashlib
import random

from brute import prose
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftgraph.llm.multiset_hash import Fingerprint, fingerprints, replace_tail, with_next

lines = st.lists(st.text(alphabet="ab \nß", max_size=40), max_size=6)


@settings(max_examples=60, deadline=None)
@given(lines, st.randoms())
def test_homomorphism(paragraphs, rnd):
    paragraphs = [p.replace("\n", " ") for p in paragraphs] or [""]
    whole = Fingerprint.of("\n".join(paragraphs))
    shuffled = list(paragraphs)
    rnd.shuffle(shuffled)
    assert whole == Fingerprint.of("\n".join(shuffled)) and str(whole) == str(Fingerprint.of("\n".join(shuffled)))
    assert whole.insert("new one") == Fingerprint.of("\n".join([*paragraphs, "new one"])) and whole.insert("x y").delete("x y") == whole
    assert Fingerprint.parse(str(whole)) == whole and whole.likeness(whole) == 1.0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\né", max_size=60), st.text(alphabet="cd\n", max_size=30), st.integers(0, 60))
def test_replacing_a_tail(text, tail, keep):
    keep = min(keep, len(text))
    edited, print_ = replace_tail(text, Fingerprint.of(text), keep, tail)
    assert edited == text[:keep] + tail and print_ == Fingerprint.of(edited)


def test_likeness_follows_the_shared_part():
    rng = random.Random(1)
    a, b = prose(rng, 400), prose(rng, 400)
    half = a[: len(a) // 2] + b[: len(b) // 2]
    fa, fb, fh = map(Fingerprint.of, (a, b, half))
    assert fa.likeness(fb) < 0.25 and 0.35 < fa.likeness(fh) < 0.7 and fa.likeness(Fingerprint.of(a + " end")) > 0.9
    assert Fingerprint.of("").likeness(Fingerprint.of("")) == 1.0 and Fingerprint.of("").likeness(fa) == 0.0


def check(df, docs):
    hashes = dict(df.sparkSession.createDataFrame([(t or "",) for _, t in docs], "text string").select("text", F.xxhash64("text")).collect())  # ties are in this order
    order = sorted(((d if d is not None else -(2**63), d, t or "") for d, t in docs), key=lambda x: (x[0], hashes[x[2]], x[2].encode()))
    expected = []
    for (_, d, t), (_, _, following) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = map(Fingerprint.of, (t, edited, following))
        expected.append((d or -1, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), a.likeness(b), a.likeness(c)))
    columns = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert sorted((r["doc_id"] or -1, *(r[c] for c in columns)) for r in df.collect()) == sorted(expected)


def test_odd_rows(spark):
    rng = random.Random(2)
    docs = [(i * 3, prose(rng, 30) + "\n" + prose(rng, 8)) for i in range(40)] + [(200, None), (201, ""), (202, "ß" * 9), (203, prose(rng, 20_000)), (None, "no id"), (500, "twice"), (500, "twice")]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("range"), F.lit("x").alias("guest"), F.lit(2).alias("n_chars")).repartition(7)
    check(fingerprints(df), docs)
    check(fingerprints(df.where("doc_id = 3")), [docs[1]])
    assert fingerprints(df.where("false")).count() == 0


def test_hot_ids(spark):
    """Rows without id, and of one id, more than a range holds: still every row's own next one, and no task with all of them."""
    rng = random.Random(6)
    docs = [(None, prose(rng, 6)) for _ in range(300)] + [(7, prose(rng, 6)) for _ in range(300)] + [(i, prose(rng, 6)) for i in range(10, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check(fingerprints(df), docs)
    sizes = with_next(df).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 300
