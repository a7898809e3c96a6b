import itertools
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://a.example.org/en/12", "http://EXAMPLE.ORG/es/x?y#z", "https://org/", "https://org", "http://x.com/de/1", "http://x.com/fr/1", "http://x.com/en/1", "noscheme.org/x", "", None, "http://", "a://b://c/d", "http://badexample.org/es/1", "http://x.com/fr", "http://x.org/a\nb", "http://x.net?u=http://y.org/"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("token", F.lit(1)).withColumn("host", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judged(df).collect()}
    assert got == {k: (*plain_parts(u), plain_rule(*plain_parts(u))[0]) for k, u in enumerate(URLS)}
    given = {r.page_id: r.verdict for r in urls.judged(df).collect() if r.rule}
    assert given == {k: plain_rule(*plain_parts(u))[1] for k, u in enumerate(URLS) if plain_rule(*plain_parts(u))[0]}


def test_mined_rules_block_what_holds_their_tokens(spark):
    rows = [(k, f"http://h{k}.x.com/{'de' if k % 2 else 'fr'}/{k}") for k in range(200)] + [(1000 + k, f"http://n{k}.net/{'de' if k % 2 else 'fr'}/{k}") for k in range(20)]
    out = urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    for r in out:
        if r.page_id >= 1000:
            assert r.rule is None and (r.verdict, r.mined is None) == (("block", False) if r.page_id % 2 else ("allow", True))
        else:
            assert r.verdict == ("block" if r.page_id % 2 else "allow") and r.mined is None


def test_mined_confidences_are_exact(spark):
    rows = [(["t:a", "t:b"], "block")] * 18 + [(["t:a"], "allow")] * 30 + [(["t:b"], "block")] * 2 + [(["t:c", "t:b"], "allow")] * 2
    found = {r.rule: (round(r.confidence, 6), round(r.support, 6)) for r in urls.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01, 0.9).collect()}
    assert found == {"t:b": (round(20 / 22, 6), round(20 / 52, 6)), "t:a t:b": (1.0, round(18 / 52, 6))}


def brute_rules(rows, least_support, least_confidence):
    """All combinations of tokens with their exact shares; of equals in rows the one of the least tokens."""
    n, out = len(rows), {}
    tokens = sorted({t for ts, _ in rows for t in ts})
    for k in range(1, len(tokens) + 1):
        for c in itertools.combinations(tokens, k):
            has = [v for ts, v in rows if set(c) <= set(ts)]
            b = sum(v == "block" for v in has)
            if b >= max(2, least_support * n) and b >= least_confidence * len(has):
                if not any(out.get(d, (0,))[0] >= b / len(has) for d in itertools.combinations(c, k - 1)):
                    out[c] = (b / len(has), b / n)
    return out


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        ts = [t for t in "abcdef" if rng.random() < 0.4]
        rows.append((ts, "block" if ({"a", "b"} <= set(ts) or "f" in ts and "c" not in ts) and rng.random() < 0.98 else "allow"))
    got = {tuple(r.tokens): (r.confidence, r.support) for r in urls.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.9).collect()}
    want = brute_rules(rows, 0.02, 0.9)
    # Needless are those with one item less as sure, whether that one is needless itself or not.
    assert got and set(got) <= set(want) and all(got[c] == pytest.approx(want[c]) for c in got)
    assert all(c in got for c in want if len(c) < 3)


def test_urls_of_many_shared_words_end_soon(spark):
    """Two URLs share 40 words, ten more have ever more words of one path: neither makes a combination of each set of words."""
    words = "/".join(f"w{k}" for k in range(40))
    rows = [(1, f"http://x.com/de/{words}/a"), (2, f"http://x.com/de/{words}/b"), (3, "http://y.com/fr/c"), (4, f"http://z.net/{words}")]
    rows += [(10 + k, f"http://n.com/{'de' if k % 2 else 'fr'}/" + "/".join(f"v{j}" for j in range(4 * k + 4))) for k in range(10)]
    rows += [(30, "http://z.net/" + "/".join(f"q{j}" for j in range(30000)))]
    began = time.time()
    out = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert time.time() - began < 60
    assert out[4].verdict == "block" and out[4].mined and out[30].verdict == "allow"


def test_a_rule_is_found_among_many_surer_items(spark):
    """Eleven items of share 0.83 and two of share 0.63 that come together on blocked rows alone: thirteen items on a row."""
    many = [f"m{k}" for k in range(11)]
    rows = [([*many, "a", "b"], "block")] * 100 + [(many, "allow")] * 20 + [(["a"], "allow")] * 59 + [(["b"], "allow")] * 59 + [([f"x{k}"], "allow") for k in range(400)]
    got = {tuple(r.tokens): r.confidence for r in urls.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01, 0.9).collect()}
    assert got[("a", "b")] == 1.0


@pytest.mark.parametrize("most_items", [0, 3, 6])
def test_rules_up_to_the_longest_equal_brute_force(spark, most_items):
    """Whatever rows FP-growth is given and whatever are counted level by level."""
    rng, names = random.Random(5), [f"t{k}" for k in range(9)]
    rows = []
    for _ in range(300):
        tokens = rng.sample(names, rng.randint(1, 8))
        rows.append((tokens, "block" if {"t1", "t2", "t3"} <= set(tokens) or rng.random() < 0.05 or {"t7", "t8"} <= set(tokens) else "allow"))
    table = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {tuple(r.tokens): (round(r.confidence, 9), round(r.support, 9)) for r in urls.mined(table, 0.03, 0.85, most_items).collect()}
    counts = {}
    for size in (1, 2, 3):
        for c in itertools.combinations(names, size):
            held = [v for t, v in rows if set(c) <= set(t)]
            b = sum(v == "block" for v in held)
            if b >= max(2, 0.03 * len(rows)) and b >= 0.85 * len(held):
                counts[c] = (b / len(held), b / len(rows))
    want = {c: v for c, v in counts.items() if not any(counts.get(p, (0,))[0] >= v[0] for p in itertools.combinations(c, len(c) - 1))}
    assert {c: v for c, v in got.items() if len(c) <= 3} == {c: (round(a, 9), round(b, 9)) for c, (a, b) in want.items()}
    assert any(len(c) == 3 for c in want) and any(len(c) == 2 for c in want)


@pytest.mark.parametrize("most_items", [0, 3, 6])
def test_rules_of_any_length_equal_brute_force(spark, most_items):
    """Whatever rows FP-growth is given and whatever the search grows by itself."""
    rng, names = random.Random(8), [f"t{k}" for k in range(9)]
    rows = []
    for _ in range(300):
        tokens = rng.sample(names, rng.randint(4, 8))
        rows.append((tokens, "block" if {"t1", "t2", "t3", "t4", "t5"} <= set(tokens) or rng.random() < 0.05 or {"t0", "t6", "t7", "t8"} <= set(tokens) else "allow"))
    table = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {tuple(r.tokens): (round(r.confidence, 9), round(r.support, 9)) for r in urls.mined(table, 0.02, 0.85, most_items).collect()}
    counts = {}
    for size in range(1, 10):
        for c in itertools.combinations(names, size):
            held = [v for t, v in rows if set(c) <= set(t)]
            b = sum(v == "block" for v in held)
            if b >= max(2, 0.02 * len(rows)) and b >= 0.85 * len(held):
                counts[c] = (b / len(held), b / len(rows))
    want = {c: v for c, v in counts.items() if not any(counts.get(p, (0,))[0] >= v[0] for p in itertools.combinations(c, len(c) - 1))}
    assert got == {c: (round(a, 9), round(b, 9)) for c, (a, b) in want.items()}
    assert {4, 5} <= {len(c) for c in want}


def test_a_url_of_many_words_is_blocked_by_a_rule_of_four(spark):
    """Twelve words on every blocked URL; only those of all of four are blocked, and eight tell nothing."""
    four, eight = [f"r{k}" for k in range(4)], [f"w{k}" for k in range(8)]
    urls_of = lambda host, top, words: f"http://{host}/{top}/" + "/".join(words)
    rows = [(k, urls_of("x.com", "de", [*four, *(w for j, w in enumerate(eight) if j != k % 9)])) for k in range(45)]
    rows += [(100 + 9 * i + k, urls_of("x.com", "fr", [*four[:i], *four[i + 1 :], *(w for j, w in enumerate(eight) if j != k)])) for i in range(4) for k in range(9)]
    rows += [(200, urls_of("n.net", "a", four)), (201, urls_of("n.net", "a", [*four[1:], *eight]))]
    out = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (out[200].verdict, out[200].mined) == ("block", " ".join(f"path:{w}" for w in four))
    assert (out[201].verdict, out[201].mined) == ("allow", None)


def test_many_words_that_each_miss_somewhere_end_soon(spark):
    """Of 16 words only all together are sure: their 65,535 subsets aren't listed."""
    words = [f"w{k:02}" for k in range(16)]
    rows = [(words, "block")] * 20 + [([w for w in words if w != x], "allow") for x in words for _ in range(5)]
    began = time.time()
    got = [(r.tokens, r.confidence) for r in urls.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()]
    assert got == [(words, 1.0)] and time.time() - began < 300


def test_of_equally_long_rules_the_greatest_text_wins(spark):
    rules = (("a.b", "/x/", "block"), ("b", "/x/yy", "allow"))
    r = urls.judged(spark.createDataFrame([(1, "http://a.b/x/yyz")], "page_id long, url string"), rules).first()
    assert (r.rule, r.verdict) == ("b/x/yy", "allow")


def test_no_pages(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def plain_targets(sizes, weights, share=1.5, epochs=2.0):
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in capped}
        left = budget - sum(capped.values())
        out = {s: left * w / sum(free.values()) for s, w in free.items()} | capped
        over = {s: epochs * sizes[s] for s in free if out[s] > epochs * sizes[s] or sizes[s] == 0}
        if not over:
            return out
        capped |= over


@pytest.fixture(scope="module")
def sized(spark):
    rows = [(k, ("a", "b", "c", None, "é")[k % 5] if k % 3 else "a", 10 + k * 7 % 90) for k in range(500)] + [(None, "b", 5), (7, "b", 11), (7, "b", 11), (900, "z", 0), (901, "z", 0)]
    return spark.createDataFrame(rows, "id long, source string, size long"), rows


def test_targets_and_takes(spark, sized):
    df, rows = sized
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = plain_targets(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    points = mixing.mix_points(df, mixing.cycled_weights(df))
    out = mixing.takes(df, points).collect()
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3
    again = mixing.takes(df, mixing.mix_points(df, mixing.cycled_weights(df))).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    other = mixing.takes(df, mixing.mix_points(df, mixing.cycled_weights(df), seed=1), seed=1).collect()
    assert sorted(map(str, out)) != sorted(map(str, other))


def test_repeated_texts(spark, odd, none):
    out = mixing.repeated(odd)
    assert out.columns == odd.columns
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(mixing.words_of(F.col("text")))).alias("n")).collect()}
    sized = mixing.sizes(odd)
    want = {r.source: r.taken for r in mixing.takes(sized, mixing.mix_points(sized, mixing.cycled_weights(sized))).groupBy("source").agg(F.sum("taken").alias("taken")).collect() if r.taken}
    assert words(out) == want
    assert mixing.repeated(none).count() == 0


def test_columns_of_any_names_are_mixed(spark):
    sized = spark.createDataFrame([(k, "ab"[k % 2], 10, "x", "y", k) for k in range(40)], "id long, source string, size long, slot string, h string, key long")
    points = mixing.mix_points(sized.select("id", "source", "size"), mixing.cycled_weights(sized))
    named = mixing.takes(sized.withColumn("target", F.lit("t")), points).collect()
    plain = {r.id: r.taken for r in mixing.takes(sized.select("id", "source", "size"), points).collect()}
    assert len(named) == 40 and all((r.slot, r.h, r.key) == ("x", "y", r.id) and r.taken == plain[r.id] and r.target > 0 for r in named)
