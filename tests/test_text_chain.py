"""Skill mentions and quotes against plain searches."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.operators import evidence, skills

SKILLS = [(1, "Java", ["JDK"]), (2, "JavaScript", ["JS", "ES6"]), (3, "Spring Boot", ["SpringBoot", "spring-boot"]), (4, "Spring", []), (5, "C++", ["CPP"]), (6, "C", ["C语言"]), (7, "Go", ["Golang"]), (8, "微服务", ["微服务架构"]), (10, ".NET", []), (11, "K8s", [])]


def entries_of(words):
    found = {}
    for skill, name, aliases in words:
        for w in (name, *aliases):
            exact = w.isascii() and len(w) <= skills.SHORT
            found.setdefault((w if exact else w.lower(), exact), skill)
    return tuple((w, e, s) for (w, e), s in sorted(found.items()))


def by_pattern(text, entries):
    """Two alternations, longest spelling first, then the leftmost of both results."""
    hits = []
    for exact in (False, True):
        some = sorted((w for w, e, _ in entries if e == exact), key=lambda w: (-len(w), w))
        edge = lambda c, look: look if c.isascii() and c.isalnum() else ""
        pattern = "|".join(edge(w[0], "(?<![A-Za-z0-9])") + re.escape(w) + edge(w[-1], "(?![A-Za-z0-9])") for w in some)
        owner = {w: s for w, e, s in entries if e == exact}
        for m in re.finditer(pattern, text, 0 if exact else re.I) if some else ():
            hits.append((owner[m[0] if exact else m[0].lower()], m.start(), m.end()))
    out = []
    for h in sorted(hits, key=lambda h: (h[1], h[1] - h[2])):
        if not out or h[1] >= out[-1][2]:
            out.append(h)
    return out


ENTRIES = entries_of(SKILLS)


@pytest.mark.parametrize("text", ["用 SpringBoot 与spring-boot、Spring", "Java、JavaScript 和 C++，C语言、C", "微服务架构与微服务", "Google 用 Go 和 golang", "GO js JS .NET x.net K8S", "", "a\0Java\0b", "ǅava JAVA"])
def test_mentions_equal_alternations(text):
    assert skills.find(text, ENTRIES) == by_pattern(text.replace("\0", " "), ENTRIES)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abAB1 +é微\n", max_size=60), st.lists(st.text(alphabet="ab1 +微", min_size=1, max_size=4).map(str.strip).filter(bool), min_size=1, max_size=8))
def test_any_dictionary_equals_alternations(text, words):
    entries = entries_of([(i, w, []) for i, w in enumerate(words)])
    assert skills.find(text, entries) == by_pattern(text, entries)


def test_a_dictionary_in_parts_finds_the_same(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["Java", "spring", "boot", "Spring Boot", "C", "c++", "Go", "x", "微服务架构"]) for _ in range(40))) for i in range(30)] + [(99, None), (98, "")], "resume_id long, full_text string")
    words = spark.createDataFrame([(i, n, "c", a) for i, n, a in SKILLS], "id long, canonical_name string, category string, aliases array<string>")
    whole = sorted(map(tuple, skills.tag(docs, words).collect()))
    assert whole and whole == sorted(map(tuple, skills.tag(docs, words, spellings=4).collect()))
    assert skills.tag(docs, words.limit(0)).collect() == [] and skills.tag(docs.limit(0), words).collect() == []
    assert [r["skill_id"] for r in skills.lookup(spark.createDataFrame([(" springboot ",), ("js",), ("JS",), ("Feign",)], "name string"), words).orderBy("name").collect()] == [3, None, 2, None]


TEXT = "旧系统改造\n负责优化系统性能，提升了响应速度。\n热点数据预热至 Redis，列表查询响应从 820ms 降至 140ms。\n新项目\n负责优化系统性能，检索准确率明显提高。"


def located(spark, quote, lo=None, hi=None, text=TEXT):
    df = spark.createDataFrame([(quote, text, lo, hi)], "quote string, text string, lo int, hi int")
    found = evidence.locate(df, "quote", "text", "lo", "hi").first()["span"]
    return found and (text[found["start"] : found["end"]], found["method"], found["start"])


def test_rounds_of_location(spark):
    second = TEXT.rindex("负责优化")
    assert located(spark, "负责优化系统性能")[2] == TEXT.index("负责优化") and located(spark, "负责优化系统性能", second, len(TEXT))[2] == second
    assert located(spark, "列表查询响应从 820ms", 0, 8)[1] == "exact"  # not in the hint: the whole text
    assert located(spark, "热点数据预热到 Redis，列表查询的响应从 820ms 降至 140ms")[1] == "fuzzy"
    assert located(spark, "“提升了响应速度。 热点数据预热至 redis”")[1] == "exact"
    assert located(spark, "主导了火星登陆项目的整体设计") is None and located(spark, "性龙") is None and located(spark, "x") is None


def all_pairs(quotes, docs, similar):
    out = set()
    for k, q in quotes:
        for d, t in docs:
            if q and t and len(q) >= evidence.LEAST_QUOTE:
                at = t.find(q)
                part = evidence.similar_part(q, t) if at < 0 and similar and len(q) >= evidence.LEAST_FUZZY else None
                if at >= 0:
                    out.add((k, d, at, at + len(q), 1.0, "exact"))
                elif part:
                    out.add((k, d, part[0], part[1], round(part[2] / 100, 3), "fuzzy"))
    return out


def test_quotes_in_a_corpus_equal_all_pairs(spark):
    """Edited quotes of every length and clipped ones at both ends; no pair is lost to the filter."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(4, 120)))) for i in range(60)] + [(98, None), (99, "")]
    quotes = []
    for i in range(150):
        t = docs[rng.randrange(60)][1]
        s = 0 if i % 7 == 0 else rng.randrange(len(t))
        q = list(t[s : s + rng.randrange(2, 90)])
        if i % 11 == 0:
            q = list("eca") + q
        for _ in range(rng.randrange(0, max(1, len(q) // 10) + 1)):
            at = rng.randrange(len(q))
            q[at : at + 1] = rng.choice([[], ["z"], [q[at], "z"]])
        quotes.append((i, "".join(q).strip(" .") or None))
    quotes += [(200, quotes[0][1]), (201, "zz"), (202, "q"), (203, None)]
    q, d = spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for similar in (False, True):
        want = all_pairs(quotes, docs, similar)
        assert set(map(tuple, evidence.locate_in_corpus(q, d, similar=similar).collect())) == want
        assert set(map(tuple, evidence.locate_in_corpus(q, d, similar=similar, chars=900).collect())) == want
    assert sum(w[5] == "fuzzy" for w in want) > 40
    plan = evidence.locate_in_corpus(q, d, similar=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Exchange" not in plan


def test_grams_are_numbers_of_their_own():
    assert len(np.unique(evidence._grams("abcabdabe😀é中"))) == len({"abcabdabe😀é中"[i : i + 3] for i in range(10)})
