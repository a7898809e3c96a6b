import re

import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.products import lcs, normalized


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw,code", [("  tmall-0000123  ", "TMALL-0000123"), ("TMALL－0000123", "TMALL-0000123"), ("ｔｍａｌｌ－１", "TMALL-1"), (None, ""), ("TM ALL-1", "TMALL-1"), ("a　b c\t", "ABC")])
def test_codes(spark, raw, code):
    assert one(spark, text.normalize_code, raw) == code


def test_compatibility_forms_go_through_nfkc(spark):
    rows = normalized(spark.createDataFrame([("①Ⅷ-ﬁ",), ("ａ-1",), (None,)], "c string"), "c", "code").collect()
    assert [r.code for r in rows] == ["1VIII-FI", "A-1", ""]


def test_other_normalizing(spark):
    assert one(spark, text.normalize_barcode, "BC-0001 23") == "BC000123"
    assert one(spark, text.normalize_text, "  NOVA   退货政策  ") == "NOVA 退货政策"


@pytest.mark.parametrize("raw,number", [(None, None), ("", None), ("--", None), ("123.45", 123.45), ("12", 12.0), (" -1e3 ", -1000.0), ("nan", None), ("1.0d", None), ("1_000", None), (".5", 0.5)])
def test_numbers(spark, raw, number):
    assert one(spark, text.extract_numeric, raw) == number


def test_tokens(spark):
    assert one(spark, text.tokens, "退，货 NOVA 政a1-B") == ["退", "货", "政", "退货", "货政", "nova", "a1", "b"]
    assert one(spark, text.tokens, None) == [] and one(spark, text.tokens, "货") == ["货"]


def test_estimated_tokens(spark):
    assert [one(spark, text.estimated_tokens, x) for x in ("", "abcd", "货货货", "货abc")] == [0, 2, 3, 1]


def plain_fixed(t, size=200, overlap=40):
    t, out, start = t.strip(), [], 0
    while start < len(t):
        if t[start : start + size].strip():
            out.append(t[start : start + size].strip())
        if start + size >= len(t):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("t", ["", "short", "甲" * 500, "x" * 200, "x" * 201, "ab " * 150, "y" * 360, "y" * 361])
def test_fixed_chunks(spark, t):
    assert one(spark, text.fixed_chunks, t) == plain_fixed(t)


def test_fixed_chunks_refuse_too_much_overlap():
    with pytest.raises(ValueError):
        text.fixed_chunks(None, 10, 10)


def test_semantic_chunks(spark):
    cut = lambda t, n: one(spark, lambda c: text.semantic_chunks(c, n), t)
    assert cut("第一句话。第二句话。第三句话。", 20) == ["第一句话。第二句话。第三句话。"]
    assert cut("第一句话。第二句话。第三句话。", 10) == ["第一句话。第二句话。", "第三句话。"]
    assert cut("短。" + "长" * 25 + "。尾。", 10) == ["短。", "长" * 10, "长" * 10, "长" * 5 + "。尾。"]
    assert cut("", 10) == [] and cut("a. b\nc", 10) == ["a. b\nc"]
    assert one(spark, lambda c: text.hierarchical_chunks(c, "T"), "一。") == ["【T】一。"]


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(row[-1], last[k + 1]))
        return row[-1]

    for a, b in (("", ""), ("abc", ""), ("TMALL-0000123", "TMALL-000012"), ("kitten", "sitting"), ("aaaa", "aa"), ("退货政策", "货政")):
        assert lcs(a, b) == plain(a, b)


def plain_semantic(body, most):
    parts = [p.strip(" ") for p in re.findall(r"[^。！？；!?;]*[。！？；!?;]|[^。！？；!?;]+", body)]
    out, buf = [], ""
    for s in parts:
        s = s.lstrip("\n ")
        while len(s) > most:
            out += [buf, s[:most]]
            s, buf = s[most:], ""
        if s and len(buf) + len(s) <= most:
            buf += s
        elif s:
            out.append(buf)
            buf = s
    return [c.strip(" ") for c in [*out, buf] if c.strip(" ")]


def test_hierarchical_chunks_leave_room_for_each_title(spark):
    body = "".join(f"{k} words of the sentence {'x' * (7 * k % 50)} end! " for k in range(30)) + "y" * 500 + " 3? 3 3"
    titles = [None, "", "abcde", "t" * 80, "t" * 300]
    rows = spark.createDataFrame([(k, t, body) for k, t in enumerate(titles)], "k int, title string, body string")
    got = {r.k: r.c for r in rows.select("k", text.hierarchical_chunks(F.col("body"), F.col("title")).alias("c")).collect()}
    for k, t in enumerate(titles):
        prefix = f"【{t}】" if t else ""
        room = max(60, 220 - len(prefix))
        assert got[k] == [prefix + c for c in plain_semantic(body, room)]
        assert max(map(len, got[k])) <= room + len(prefix)


def plain_compressed(query, body, most):
    if len(body) <= most:
        return body
    word = lambda x: set(re.findall("[a-z0-9]+", x.lower()))
    parts = [s for s in (p.strip() for p in re.findall(r"[^!?;]*[!?;]|[^!?;]+", body)) if len(s) >= 6]
    asked, kept, used = word(query), set(), 0
    for _, k in sorted((-len(asked & word(s)) / max(len(asked), 1), k) for k, s in enumerate(parts)):
        if asked & word(parts[k]) and used + len(parts[k]) <= most and used < 0.8 * most:
            kept.add(parts[k])
            used += len(parts[k]) + 1
    return "\n".join(s for s in parts if s in kept) if kept else body[:most]


@pytest.mark.parametrize("query", ["alpha beta", "gamma", "nothing", ""])
@pytest.mark.parametrize("most", [30, 80, 400])
def test_compressing_keeps_the_sentences_that_share_words(spark, query, most):
    body = "alpha one two three! no match here at all; beta alpha again? tiny! " + "gamma " * 12 + "! alpha closes the text 3;"
    row = spark.createDataFrame([(query, body)], "q string, t string")
    assert row.select(text.compressed_text(F.col("q"), F.col("t"), F.lit(most)).alias("x")).first().x == plain_compressed(query, body, most)
