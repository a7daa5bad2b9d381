"""Filter audit, phrase collocations and chat formatting: brute force, awkward rows, templates that misbehave."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import chat, collocations, filteraudit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "part mask n good toxic digest of first_id words phrase key count suffix deal n_words lang_ rank a l r score salt segment context at range lo spans formatted".split()


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns], F.lit("clash").alias("a.b"))


# -- 11 ---------------------------------------------------------------------------------


def audit_brute(docs, labels):
    smallest = {}
    for i, text, _ in docs:
        if i is not None and (text or "") not in smallest:
            smallest[text or ""] = i
        elif i is not None:
            smallest[text or ""] = min(i, smallest[text or ""])
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > smallest[text]}
        rows.append((lang or "", {f for f in "ABCDE" if fails[f]}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                hit = [r for r in mine if letter in r[1] and not r[1] & before]
                shapley[part, letter] += len(hit)
                out[part, "".join(order), step] = (
                    sum(not r[1] & set(order[:step]) for r in mine), len(hit), sum(letter in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {letter} for r in mine), sum(r[2] for r in hit), sum(r[3] for r in hit),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    rows = filteraudit.audit(filteraudit.failures(docs), labels).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_is_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert audited(docs, labels) == audit_brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_audit_odd_rows(spark):
    many = " ".join(f"w{i}" for i in range(300))
    docs = [(1, many, "en"), (2, many, "en"), (2, many, "en"), (2, many, None), (None, many, "en"), (None, None, None), (3, None, "en"), (4, "", "fr"), (5, "A B " * 150, "fr"), (6, "a b " * 250, ""), (7, "x " * 100_000 + "#", "en"), (8, many + " A" * 400, "de"), (8, "another", "de")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (2, 1, 1), (None, 1, 1), (3, None, 1), (7, 1, None), (99, 1, 1)]
    df, ls = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(clashing(df), clashing(ls)) == audit_brute(docs, labels)
    assert audited(df, ls.limit(0)) == audit_brute(docs, [])
    assert audited(df.limit(0), ls) == {}


def test_audit_of_other_filters(spark):
    """Three filters, 2^3 by 3! * 3 matrices; order and step by hand."""
    failed = spark.createDataFrame([(1, "p", 0b011), (2, "p", 0b001), (3, "p", 0b000), (4, "q", 0b110)], "doc_id long, part string, mask int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost) for r in filteraudit.audit(failed, labels, "XYZ").collect()}
    assert len(got) == 2 * 6 * 3
    assert got["p", "YXZ", 1] == (2, 1, 0, 0, 1) and got["p", "YXZ", 2] == (1, 1, 1, 1, 0) and got["q", "ZYX", 2] == (0, 0, 1, 0, 0)


# -- 12 ---------------------------------------------------------------------------------


def phrases_brute(docs, max_n, least, top, covered=50):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        inside = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= covered * a for b in inside):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i): (p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)}


def mined(docs, **settings):
    rows = collocations.collocations(docs, **settings).collect()
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")


@pytest.mark.parametrize("settings", [{"max_n": 3, "least": 10, "top": 2000}, {"max_n": 4, "least": 7, "top": 40}, {"max_n": 2, "least": 3, "top": 100}])
def test_phrases_are_brute_force(texts, settings):
    assert mined(texts, **settings) == phrases_brute([tuple(r) for r in texts.collect()], **settings)


def test_phrases_with_hot_words_and_small_flushes(texts, monkeypatch):
    """First words and pairs dealt out further, flushes of a few words, numbers too large for the vocabulary."""
    monkeypatch.setattr(collocations, "FLUSH", 1000)
    monkeypatch.setattr(collocations, "SHARE", 20_000)
    hot = collocations._hot(texts, 200, 3)
    assert {len(p.split(" ")) for p in hot} == {2, 3}
    assert mined(texts) == phrases_brute([tuple(r) for r in texts.collect()], 3, 10, 2000)


def test_words_are_halved_if_their_numbers_grow_too_large():
    many = [f"w{i}" for i in range(200)]
    words, row, piece = collocations._words(pa.array([" ".join(many[:190]) + ". a", None, " ".join(many[190:])]))
    merged = Counter()
    for b in collocations._counted(words, row * 0, piece, ["x y%"], len(words), 9, {}):  # 202^9 is above 2^62
        for s, c in zip(b["suffix"].to_pylist(), b["count"].to_pylist()):
            merged[s] += c
    pieces = [many[:190], ["a"], many[190:]]
    assert merged == Counter(" ".join(["x%20y%25", *p[i : i + 9], ""]) for p in pieces for i in range(len(p)))


def test_prefixes_are_counted_across_batches():
    """Runs that go on over batches and slices, long words, words that begin alike, prefixes that are suffixes themselves."""
    import random

    r = random.Random(8)
    pool = ["a", "ab", "b" * 60, "b" * 61, "é", "zz"]
    rows = sorted({" ".join(["en", *[r.choice(pool) for _ in range(r.randrange(1, 4))], ""]) for _ in range(150)} | {"de a ", "fr a a a "}, reverse=True, key=str.encode)
    weight = {s: r.randrange(1, 5) for s in rows}
    want = Counter()
    for s in rows:
        words = s.split(" ")[:-1]
        for k in range(len(words)):
            want[" ".join(words[: k + 1]), k] += weight[s]
    for size in (1, 2, 7, 1000):
        batches = [pa.RecordBatch.from_pydict({"suffix": rows[i : i + size], "deal": pa.array([1] * len(rows[i : i + size]), pa.int8()), "count": pa.array([weight[s] for s in rows[i : i + size]], pa.int64())}) for i in range(0, len(rows), size)]
        got = [(key, k, n) for b in collocations._stacked(iter(batches), 3, 6) for key, k, n in zip(b["key"].to_pylist(), b["n_words"].to_pylist(), b["count"].to_pylist())]
        assert len(got) == len(set(got)) and {(key, k): n for key, k, n in got} == {x: n for x, n in want.items() if n >= 6 or x[1] == 0}


def test_phrases_odd_rows(spark):
    docs = [("A b" + "\t" * 3 + "c. a b c", "en"), (None, "en"), ("", "en"), ("  ,.;", "fr"), ("a b c d", None), ("a b c " * 50_000, "en"), ("É é\x0bA", "a b%+"), ("É é A", "a b%+"), ("x\x00y z", "und"), ("x\x00y z", None), ("straße übergröße " * 3, ""), ("a b c", "en")] * 2
    df = spark.createDataFrame(docs, "text string, lang string")
    for least in (1, 2, 4):
        assert mined(clashing(df), least=least) == phrases_brute(docs, 3, least, 2000)
    assert mined(df.limit(0)) == {}
    assert mined(df.where("lang = 'fr'")) == {}


def test_products_beyond_64_bits(spark, monkeypatch):
    rows = [("und", "", 0, 10**13), ("und", "p", 1, 9 * 10**12), ("und", "q", 1, 8 * 10**12), ("und", "p q", 2, 7 * 10**12)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, n_words int, count long"))
    assert mined(spark.range(0)) == {("und", 1): ("p q", 7 * 10**12, 9 * 10**12, 8 * 10**12, 10**13, 10**6 * 49 // 72)}


# -- 13 ---------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("us\\\n|p<", max_size=4), st.text("<|\\im_endstar>\nab", max_size=30)), max_size=4))
def test_turns_come_back(turns):
    out = chat.chatml_render(turns)
    assert list(chat.chatml_parse(out)) == turns
    found = chat.locate(chat.chatml_render, turns, loss_roles=frozenset(r for r, _ in turns))
    assert found.formatted == out and found.rewritten_at is None
    assert [chat.unescape(out[s["loss_start"] : s["loss_end"]]) for s in found.spans] == [t for _, t in turns]
    assert [s["end"] for s in found.spans] == [len(chat.chatml_render(turns[: k + 1])) for k in range(len(turns))]


def digests(rows):
    """conv_id -> n_turns, turns, loss characters and loss text by plain Python."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.chatml_render(turns)))
    return out


def read(df, template=chat.CHATML):
    rows = chat.read_back(chat.formatted(df, template), template).collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in rows}
    assert len(got) == len(rows)
    return got


TURNS = "conv_id long, turn long, role string, text string"


def test_conversations_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, None, "user", "last"), (None, 3, None, "x"), (None, 2, "assistant", ""), (3, 0, "a\nb\\|p", "\n<|im_end|>\n"), (4, 0, "assistant", "<" + "\\" * 9 + "|im_end|>" + "é" * 200_000 + "\n")]
    rows += [(5, k // 3, "assistant" if k % 2 else "user", f"turn {k} <|im_start|>" * (k % 5)) for k in range(1000)]
    df = spark.createDataFrame(rows, TURNS)
    assert read(clashing(df)) == digests(rows)
    assert read(df, chat.CHATML._replace(reach=None)) == digests(rows)
    assert read(df.limit(0)) == {}


@pytest.mark.parametrize("reach", [0, 1, 5])
def test_segments_see_the_turns_before_them(spark, reach):
    """A template that numbers a turn by the roles before it: right in every segment, as far as it looks back."""
    rows = [(c, k, "user" if k % 3 else "assistant", f"t{k}") for c in (1, 2) for k in range(100 * c)] + [(3, 0, "user", "one")]
    def render(turns):
        return "".join(f"[{'-'.join(r[0] for r, _ in turns[max(0, k - reach) : k + 1])}:{text}]" for k, (_, text) in enumerate(turns))

    whole, cut = chat.formatted(spark.createDataFrame(rows, TURNS).repartition(7), chat.Template(render, chat.chatml_parse, str, reach))
    assert [r.formatted for r in whole.collect()] == ["[u:one]"]
    pieces = defaultdict(dict)
    for r in cut.collect():
        pieces[r.conv_id][r.segment] = r
    for c in (1, 2):
        turns = [(r, t) for conv, _, r, t in rows if conv == c]
        got = [pieces[c][s] for s in sorted(pieces[c])]
        assert len(got) == -(-100 * c // chat.CUT) and max(r.n_turns for r in got) <= chat.CUT
        assert "".join(r.formatted for r in got) == render(turns)
        assert [r.formatted[s.loss_start : s.loss_end] for r in got for s in r.spans if s.role == "assistant"] == [t for r, t in turns if r == "assistant"]


def test_templates_that_rewrite_history(spark):
    """One that strips earlier answers' thoughts when the user speaks again, and one that closes with a mark."""
    def strips(turns):
        last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=0)
        return "".join(f"{r}:{t if k > last else re.sub('<t>.*?</t>', '', t)}|" for k, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<t>hm</t>yes"), (1, 2, "user", "more"), (2, 0, "user", "q"), (2, 1, "assistant", "yes")]
    df = spark.createDataFrame(rows, TURNS)
    found = {r.conv_id: r for r in chat.formatted(df, chat.Template(strips, chat.chatml_parse, str, None))[0].collect()}
    assert found[1].rewritten_at == 2 and found[1].formatted == "user:q|assistant:yes|user:more|" and found[1].spans == []
    assert found[2].rewritten_at is None and [(s.loss_start, s.loss_end) for s in found[2].spans] == [(None, None), (17, 20)]
    closing = chat.Template(lambda turns: "".join(t for _, t in turns) + "</s>", chat.chatml_parse, str, 1)
    assert {r.rewritten_at for r in chat.formatted(df, closing)[0].collect()} == {1}


def test_text_that_a_template_hides_has_no_loss():
    found = chat.locate(lambda turns: "".join(f"{r}:{len(t)};" for r, t in turns), [("user", "abc"), ("assistant", "defg")])
    assert found.formatted == "user:3;assistant:4;" and [s["loss_start"] for s in found.spans] == [None, None] and [s["end"] for s in found.spans] == [7, 19]
    upper = chat.locate(lambda turns: "".join(f"({t.upper()})" for _, t in turns), [("assistant", "é<")])
    assert upper.spans[0]["loss_start"] is None
