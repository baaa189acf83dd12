"""Each corpus operator on small tables: brute force, nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import quality, topk_search, toxicity
from siftwell.llm.components import components
from siftwell.llm.fingerprints import edited_fingerprints, text_form
from siftwell.llm.html_text import extract_text, main_text
from siftwell.llm.mixing import mix_sources, sainte_lague, targets
from siftwell.llm.near_dedup import near_duplicates
from siftwell.llm.packing import pack, pack_tails
from siftwell.llm.pii import find, personal_data, redact, spelled_out
from siftwell.llm.substring_dedup import _held, _keys, _named, remove_repeats
from siftwell.llm.topk_search import top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """doc_id, text: random texts, exact copies, a family of near copies, shared passages, runs, edge cases."""
    rng = random.Random(3)
    out = [(i, text(rng, rng.randrange(1, 120))) for i in range(60)]
    base = text(rng, 80).split()
    for i in range(60, 110):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(1000)}"
        out.append((i, " ".join(own)))
    passage = text(rng, 25)
    out += [(110 + i, text(rng, 10) + "  " + passage + "\n" + text(rng, 10)) for i in range(6)]
    out += [(116, "a " * 40), (117, "b a " + "a " * 30 + "c"), (118, None), (119, ""), (120, " \t\n "), (121, "one two"), (122, "ONE two"), (123, out[3][1]), (124, out[3][1].upper()), (125, text(rng, 6000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", f"s{i % 3}" if i % 7 else None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, toxic int")


def shingles(t, lower=True):
    t = t or ""
    w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}) if lower else t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, rows, empty):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find_root(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find_root(i), find_root(j)))
                root[b] = a
    got = {r.doc_id: r for r in near_duplicates(docs, percent=85).collect()}
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find_root(i), find_root(i) == i), i
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_null_and_repeated_ids(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (9, t)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(False, 5, 5, True), (False, 5, 5, True), (False, 9, 5, False), (True, 0, None, True)]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    for small in (0, 1000):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
        assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30)) and len(got) == 69


def test_remove_repeats(docs, rows, empty):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                keep[j : j + 13] = [False] * 13
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k)), i
    assert remove_repeats(empty).count() == 0


def test_names_of_a_hot_text_do_not_grow_with_its_copies(spark):
    rng = random.Random(12)
    hot = text(rng, 60)
    rows = [(i, hot) for i in range(300)] + [(300, hot + " more"), (301, "less " + hot)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    lists = [r.names for r in _held(df, 13).collect()]
    assert len(lists) == 3 and all(len(x) == len(set(x)) <= 60 for x in lists)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([hot, hot])], ["id", "text"])
    given = [x.num_rows for x in _named(13)([batch, batch])]
    assert given[0] == len(set(lists[0])) and sum(given[1:]) == 0
    got = {r.doc_id: r.n_removed for r in remove_repeats(df.withColumnRenamed("id", "doc_id")).collect()}
    assert [got[i] for i in (0, 1, 299, 300, 301)] == [0, 60, 60, 60, 60]


def test_texts_of_one_node_are_listed_whole(spark):
    rng = random.Random(15)
    known = spark.createDataFrame([(i, text(rng, 40, 10**6), i) for i in range(3)], "id long, text string, t long")
    names = _held(known, 13).collect()
    node = known.mapInArrow(_keys, "id long, t long, n long, node long, more long").filter("id = 1").select("node")
    assert names == [] and [r.node for r in _held(known, 13, node).collect()] == [node.first().node]


def test_rows_of_one_id_are_decided_by_their_own_texts(spark):
    from siftwell.llm.stages import drop_near_duplicates

    rng = random.Random(21)
    a, b, c = text(rng, 60), text(rng, 60), text(rng, 60)
    rows = [(3, a), (7, a), (7, b), (7, b + " more"), (7, b), (8, a + " less"), (9, c), (9, None), (9, ""), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in drop_near_duplicates(spark, df, "").collect()]
    sevens = [t for i, t in left if i == 7]
    assert len(sevens) == 1 and sevens[0] in (b, b + " more")
    assert sorted((i, t or "", t is None) for i, t in left if i not in (7, None)) == sorted((i, t or "", t is None) for i, t in ((3, a), (9, c), (9, None), (9, ""))) and (None, a) in left

    own = text(rng, 60)
    got = {(r.doc_id, r.kept_text): r.n_removed for r in remove_repeats(spark.createDataFrame([(3, a), (7, a), (7, own), (7, b + " " + a), (8, own)], "doc_id long, text string")).collect()}
    assert got == {(3, a): 0, (7, ""): 60, (7, own): 0, (7, b): 60, (8, ""): 60}


def test_pack_round_trip(docs, rows, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in pack(docs, path, window=64).collect():
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(bytes(r.tokens) for r in own) == ids.tobytes() and own[0].doc_tokens == len(ids)
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        n = sum(r.length for r in s)
        assert n <= 64 and (n >= 60 or not n & (n - 1))
    assert pack(empty, path).count() == 0


def test_pack_odd_texts(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    odd = ["  two  spaces \n\n", "a  b c", "<|endoftext|> x", "日本語 テキスト", "don't  we'll", "\x1c\x1d x", " ", "é" * 50, "tab\tand\r\nline"]
    got = {r.doc_id: zlib.crc32(bytes(r.tokens)) for r in pack(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), public.path("byte_bpe_50k.json"), window=4096).filter("start = 0 AND length = doc_tokens").collect()}
    for i, c in got.items():
        assert c == zlib.crc32(np.array([*tok.encode(odd[i], add_special_tokens=False).ids, 0], "<u4").tobytes()), odd[i]


def test_tails_of_one_size():
    out = pack_tails([600] * 1000, 1024)
    assert sum(n for n, _ in out) == 600_000 and sum(1 for n, _ in out if n < 1020 and n & (n - 1)) == 0


def test_mixing(docs, rows, empty):
    got = mix_sources(docs).collect()
    by = defaultdict(lambda: [0, 0, 0.0])
    source = {i: (f"s{i % 3}" if i % 7 else None) for i, _ in rows}
    for r in got:
        assert r.size == len(WORD.findall(dict(rows)[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        assert r.taken == r.passes * r.size + sum(b - a for a, b in zip(r.ranges[::2], r.ranges[1::2], strict=True))
        own = by[source[r.doc_id]]
        own[0] += r.size
        own[1] += r.taken
        own[2] = r.target
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = targets([by[s][0] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    for s, goal in zip(names, want, strict=True):
        assert by[s][2] == pytest.approx(goal) and abs(by[s][1] - goal) <= max(0.02 * goal, 2)
    assert sorted((r.doc_id, r.taken) for r in mix_sources(docs.orderBy(F.rand())).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mix_sources(empty).count() == 0


def test_quotas():
    assert targets([10, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([20, 590 / 3, 295 / 3])
    votes, seats = [53, 24, 23], 7
    by_hand = [0, 0, 0]
    for _ in range(seats):
        by_hand[max(range(3), key=lambda i: votes[i] / (2 * by_hand[i] + 1))] += 1
    assert sainte_lague(votes, seats) == by_hand and sum(sainte_lague([1.0] * 7, 1000)) == 1000


def test_personal_data(spark, empty):
    cases = {
        "mail a.b@ex.com now": "email:5:15",
        "john.doe at mail dot example dot com": "email:0:36",
        "joe (at) ex [dot] org": "email:0:21",
        "ｊｏｅ＠ｅｘ．ｃｏｍ": "email:0:10",
        "ip 1.2.3.4 and 1.2.3.400": "ip:3:10",
        "card 4111-1111-1111-1111.": "card:5:24",
        "call plus one five five five one two three four five six": "phone:5:56",
        "call +1 (017) 555-7713": "phone:5:22",
        "they met at the house. Dots at noon": "",
        "": "",
    }
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(cases)] + [(99, None, None)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in personal_data(df).collect()}
    for i, (t, want) in enumerate(cases.items()):
        assert got[i].spans == want, t
    assert got[99].redacted is None and got[0].redacted == "mail <EMAIL> now" and got[0].n_email == 1
    base, added = find("x 1.2.3.4 y")
    assert redact("x 1.2.3.4 y", base + added) == "x <IP> y" and spelled_out(base) == "ip:2:9"
    assert personal_data(empty).count() == 0


def test_personal_data_half_spelled():
    cases = {
        "+1 five 5 five 0 one 2 three 4 five 6": "phone:0:37",
        "no\xa0space +1 five 5 five 0 one 2 three 4 five 6": "phone:9:46",
        "4111 1111 1111 11 one one": "card:0:25",
        "10 dot zero dot 0 dot 7": "ip:0:23",
        "10.zero.0.7": "ip:0:11",
        "10.0.0.ſeven": "ip:0:12",
        "joe at mail dot ca": "email:0:18",
        "joe at mail [dot] ca": "email:0:20",
        "JOE AT MAIL DOT CA": "email:0:18",
        "look at mail.ca, at the dot product, at one of 5 or 5 one": "",
        "４111 1111 1111 1111 one": "card:0:19",
    }
    for t, want in cases.items():
        base, added = find(t)
        assert not base and spelled_out(added) == want, t


def test_html(spark):
    page = '<html><head><title>T &amp</title><script>var a="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy &amp; win</div><article><h1>T</h1><p>One &amp; two&nbsp; three<br>four<p>Five.<!-- <p>no --></p><aside>see also this</aside></article><div id="comments"><p>nice text, thanks</p></div><footer>&copy; me</footer>'
    assert main_text(page) == "T\nOne & two three four\nFive."
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "y"), (None, "v", "", "z"), (4, "w", "<p " + "x" * 1000, "q")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract_text(df).collect()}
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[None].text == "" and got[4].n_chars >= 0


PROSE = ["It was " + " ".join(f"word{i}x{j}" for i in range(n)) + "." for j, n in enumerate((60, 45, 80, 38))]
MENU = "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sports", "About us")) + "</ul>"


def test_html_without_article_markup():
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    page = f"<html><body><div>{MENU}</div><div><h2>A heading</h2>{body}</div><div><a href=/x>Older posts</a> <a href=/y>Newer posts</a></div><div>{MENU}</div></body></html>"
    assert main_text(page) == "\n".join(["A heading", *PROSE])


def test_html_with_misleading_classes():
    body = "".join(f"<p>{p}</p>" for p in PROSE)
    assert main_text(f'<body><div>{MENU}</div><div class="widget promo">{body}</div><div>{MENU}</div></body>') == "\n".join(PROSE)
    assert main_text(f'<body class="has-sidebar"><div class="page with-menu widget">{MENU}<article>{body}</article></div></body>') == "\n".join(PROSE)
    links = "".join(f'<li><a href="/{i}">Another story number {i}</a></li>' for i in range(6))
    assert main_text(f"<article>{body}<ul>{links}</ul></article>") == "\n".join(PROSE)  # by its links, though the article holds it
    remarks = "".join(f"<p>I think {p}</p>" for p in PROSE)
    assert main_text(f'<article>{body}<div class="comments">{remarks}</div></article>') == "\n".join(PROSE)


@pytest.mark.parametrize("piece", ["<a ", "<![CDATA[", "<![CDATA[x>", "<!--", "</script ", "<script>", '<a ">', "<a '\">", "<p class=\"", "&amp", "<div></x>"])
def test_html_of_a_megabyte_is_read_once(piece):
    began = time.time()
    main_text("<p>x" + piece * (1_000_000 // len(piece)))
    assert time.time() - began < 2


def test_html_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "<article>a</article>", "x")] * 2, "page_id long, url string, html string, text string")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in extract_text(df).collect()] == [(1, "u", "a", 1)] * 2
    assert extract_text(df.limit(0)).count() == 0


def test_fingerprints(docs, rows, empty):
    got = sorted(edited_fingerprints(docs).withColumn("hex", text_form(F.col("fingerprint"))).collect(), key=lambda r: -r.doc_id)
    order = sorted(rows, key=lambda r: -r[0])
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    gaps = []
    for k, r in enumerate(got):
        t, nxt = order[k][1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert (r.doc_id, r.n_chars, r.edited_text) == (order[k][0], len(t), edited)
        gaps += [r.near_edited - jac(shingles(t, False), shingles(edited, False)), r.near_next - jac(shingles(t, False), shingles(nxt, False))]
    assert np.mean(np.abs(gaps)) < 0.04
    same = {r.doc_id: r.hex for r in got}
    assert same[123] == same[3] and same[118] == same[119] == same[120] == "" and len(same[3]) == 256
    assert edited_fingerprints(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)) * 0.3
    x[100:140] = x[7]
    x[150:155] = 0
    rows = [(i, [float(c) for c in v], "q") for i, v in enumerate(x)] + [(400, None, "q"), (450, [1.0, float("nan")], "q"), (500, [0.1, None], "q"), (None, [1.0] * 8, "q"), (50, [float(c) for c in x[50]], "q")]
    got = defaultdict(list)
    for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = np.floor(256 * x).astype(np.int64)
    for q in range(0, 300, 50):
        s = whole @ whole[q]
        want = [(int(j), int(s[j])) for j in np.lexsort((np.arange(300), -s)) if j != q][:5]
        assert got[q] == want
    assert set(got) == set(range(0, 300, 50))
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    few = top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]


def test_top_k_of_clusters_in_many_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "GROUP", 20)
    monkeypatch.setattr(topk_search, "BLOCK", 40)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 6)) * 20
    x = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)) * 0.1
    x[:300] = centres[0] + rng.normal(size=(300, 6)) * 0.1  # a cell with too many queries
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in top_k(df, k=3, every=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = np.floor(256 * x).astype(np.int64)
    for q in range(0, 1500, 3):
        s = whole @ whole[q]
        assert got[q] == [(int(j), int(s[j])) for j in np.lexsort((np.arange(1500), -s))[:4] if j != q][:3]
    assert top_k(spark.createDataFrame([(0, [1e300]), (50, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        words = text(rng, 60, 200).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["idiot", "worthless", "moron", "scum"]) if i % 12 else f"grawlix{rng.randrange(50)}"
        rows.append((i, " ".join(words), i))
        if i < 200:
            labels.append((i, int(bad)))
    rows += [(300, None, 1), (301, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic long")
    labels = spark.createDataFrame([*labels, (None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held_out = [(i % 6 == 0, got[i].toxic) for i in range(200, 300)]
    assert np.mean([a == b for a, b in held_out]) >= 0.97 and sum(b and not a for a, b in held_out) <= 1
    assert not got[300].toxic and not got[301].toxic
    assert not any(r.toxic for r in toxicity.score(docs, toxicity.train(docs, empty.select("doc_id", "toxic"))).collect())
    assert toxicity.score(empty, chain).count() == 0


def test_quality(spark, empty):
    rng = random.Random(5)

    def clean():
        return " ".join(text(rng, rng.randrange(6, 14), 3000).capitalize() + "." for _ in range(8))

    junk = [lambda: " ".join(w + "***" for w in text(rng, 60, 3000).split()), lambda: " ".join(w.upper() + "!!" for w in text(rng, 60, 3000).split()), lambda: " | ".join(text(rng, 60, 3000).split()), lambda: " ".join(w for w in text(rng, 6, 3000).split() for _ in range(15))]
    rows = [(i, junk[i % 4]() if i % 5 == 0 else clean(), "k") for i in range(400)] + [(400, None, "k"), (401, " ", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs)).collect()}
    assert np.mean([got[i].kept == (i % 5 != 0) for i in range(400)]) >= 0.97
    assert not got[400].kept and got[401].score == 0.0
    assert quality.score(empty, quality.train(empty)).count() == 0


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(6)
    base = text(rng, 90)
    rows = [(i, text(rng, 60), "en", f"s{i % 2}", 0) for i in range(80)] + [(80, base, "en", "s0", 0), (81, base + " more", "en", "s1", 0), (82, "mail me at a@b.com " + text(rng, 30), "en", "s0", 0), (83, None, None, None, None)]
    bad = [(100 + i, text(rng, 40) + " idiot moron " + text(rng, 5), "en", "s1", 0) for i in range(20)]
    docs = spark.createDataFrame([(i, t, a, s, len(t) if t else None) for i, t, a, s, _ in rows + bad], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0) for i in range(80)] + [(100 + i, 1) for i in range(15)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        at = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = at
        assert name == "packing" or at.schema.names == docs.schema.names
    ids = lambda t: {r.doc_id for r in t.select("doc_id").collect()}
    assert ids(seen["toxicity"]) == set(range(84))
    assert ids(seen["near_dedup"]) == set(range(84)) - {81}
    assert "<EMAIL>" in seen["pii"].filter("doc_id = 82").first().text
    assert all(r.n_chars == len(r.text) for r in seen["mixing"].collect()) and ids(seen["mixing"]) <= set(range(83))
    assert {r.doc_id for r in seen["packing"].collect()} == ids(seen["mixing"])


def test_digest_queries_follow_their_operators(spark, docs, tmp_path):
    from siftwell.llm.queries import op1_packing, op9_fingerprints, op10_substring_dedup

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op10_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[118].kept_sha256 == hashlib.sha256(b"").hexdigest()
    seen, kept = set(), {}
    for i, t in sorted(docs.select("doc_id", "text").collect()):
        w = WORD.findall(t or "")
        windows = [tuple(w[j : j + 13]) for j in range(len(w) - 12)]
        gone = {k for j, x in enumerate(windows) if x in seen for k in range(j, j + 13)}
        seen.update(windows)
        kept[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    pieces = op1_packing(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in pieces} == set(texts)
    for r in pieces:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    assert {len(r.edited_sha256) for r in op9_fingerprints(spark, str(tmp_path)).collect()} == {64}


def thue_morse(n=1024):
    """A word and its complement, which sums of powers modulo 2**64 cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_in_sums_of_powers(spark):
    one, two = thue_morse()
    rows = [(1, " ".join([one] * 3 + [f"x{i}" for i in range(12)])), (2, " ".join([two] * 3 + [f"x{i}" for i in range(12)])), (3, " ".join([one] * 15)), (4, " ".join([two] * 15))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = packing_ids(pack(df, public_tokenizers.path("byte_bpe_50k.json")))
    for i, t in rows:
        assert ids[i] == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def packing_ids(pieces):
    """doc_id -> ids, from the pieces in order."""
    out = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: (r.doc_id, r.start)):
        out[r.doc_id] += np.frombuffer(bytes(r.tokens), "<u4").tolist()
    return out


def test_a_family_of_templates_is_not_paired_out(spark):
    """Texts that share all but two words each, below the threshold, and a few true near copies among them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(104)]
    rows = []
    for i in range(600):
        own = list(base)
        for at in rng.sample(range(104), 2):
            own[at] = f"x{rng.randrange(10**7)}"
        rows.append((i, " ".join(own)))
    rows += [(600 + i, rows[i][1] + " end") for i in range(5)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    above = {i: i for i in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids[i + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                above[b] = a
    assert got == {i: root(i) for i in ids}


def plain_base(text):
    """The base spans of a text, straight from the four patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        doubled = [2 * d if i % 2 else d for i, d in enumerate(reversed(digits))]
        if 14 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0:
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_base_spans_and_digests_equal_the_patterns(spark, tmp_path):
    from siftwell.llm.queries import op7_pii

    rng = random.Random(12)
    bits = ["a@b.c", "@", ".", "1", "22", "300", ".4", "five", "one", "dot", "at", "(at)", "-", "+", "(", ")", "joe", "x.com", "٣", "4111", "1111", "a@", "b@c", ".d", "+1", "555"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "", "."]) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "x" * 50 + "@" + "y.z" * 40, "1.2.3.4.5.6.7.8", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op7_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        want = plain_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [want.count(k + ":") for k in ("email", "ip", "card", "phone")]
        assert not want or set(want.split(",")) <= set(got[i].spans.split(","))


def test_disguises_with_offsets():
    cases = {
        "Ꮯall: јoe@ех.com or 1.2.3.4": [("email", "јoe@ех.com"), ("ip", "1.2.3.4")],  # Cyrillic letters beside a base span
        "a@b.co, then ann (at) web [dot] net; IP 10 dot 0 dot 0 dot 1": [("email", "a@b.co"), ("email", "ann (at) web [dot] net"), ("ip", "10 dot 0 dot 0 dot 1")],
        "١٠.٠.٠.٧ and ｊｏｅ＠ｅｘ．ｃｏｍ": [("ip", "١٠.٠.٠.٧"), ("email", "ｊｏｅ＠ｅｘ．ｃｏｍ")],
        "to jo\u200be@ex\u200b.com now": [("email", "jo\u200be@ex\u200b.com")],
        "card: four one one one 1111 1111 1111.": [("card", "four one one one 1111 1111 1111")],
        "ring oh no +44 20 7946 0958 or plus four four 20 seven nine 46 0958": [("phone", "+44 20 7946 0958"), ("phone", "plus four four 20 seven nine 46 0958")],
        "mail joe＠ex.com or joe@ex.com": [("email", "joe＠ex.com"), ("email", "joe@ex.com")],
        "x at y dot org, x at y dot org": [("email", "x at y dot org")],
    }
    for t, want in cases.items():
        base, added = find(t)
        got = {(k, t[a:b]) for a, k, b in base + added}
        assert {(("email", "ip", "card", "phone").index(k), x) for k, x in want} <= got, (t, got)


@pytest.mark.parametrize("piece", ["1", "1.", "a", "a@", "a@b.", " ", "(at) ", "5 ", "+1 ", "five ", "a dot ", " (at", "one.two.three.four "])
def test_personal_data_of_a_megabyte_in_one_scan(piece):
    began = time.time()
    find(piece * (1_000_000 // len(piece)) + ".@ five 5")
    assert time.time() - began < 4


def test_personal_data_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "1.2.3.4"), (5, "1.2.3.4"), (5, "1.2.3.4"), (5, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_ip, r.spans) for r in personal_data(df).collect()) == [(0, 1, "ip:0:7"), (5, 0, ""), (5, 1, "ip:0:7"), (5, 1, "ip:0:7")]
