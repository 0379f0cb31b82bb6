"""Each operator on small tables, against plain Python: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from setlist.llm import (
    decontaminate, exact_dedup, html_main, jaccard_join, language_id, line_dedup, lm_score, mixing, secrets, url_filter,
)
from setlist.llm.elias_fano import EliasFano, MappedFile, NgramTrie

SPACE = r"[\x20\x09-\x0D]"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(make_docs):
    base = prose(1, 200).split()
    near = base[:]
    near[100] = "changed"
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, "Hello  World", "en", "a"), (5, "HelloWorld", "en", "b"),
        (6, "Hello World", "en", "a"), (6, "Hello World", "en", "a"), (None, "Hello World", "fr", None), (7, " ".join(base), "en", "a"),
        (8, " ".join(near), "en", "a"), (9, prose(2, 30_000), "en", "b"), (10, "one two", "fr", "b"), (11, "ONE two", "fr", "b"), (12, "42 %%", "en", "b"),
    ]


def test_exact_groups(spark, make_docs, odd):
    got = exact_dedup.exact_groups(make_docs(odd)).collect()
    assert len(got) == len(odd)
    groups = defaultdict(list)
    for doc_id, text, *_ in odd:
        groups[re.sub(SPACE, "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert (r["keep_id"], r["group_size"]) == (min(groups[key])[3], len(groups[key]))
    assert sum(r["kept"] for r in got) == len(groups)
    docs = make_docs(odd)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def test_exact_groups_with_a_filter_that_is_too_small(make_docs):
    data = [(i, f"text {i % 70}", "en", "a") for i in range(100)]
    got = exact_dedup.exact_groups(make_docs(data), max_filter_bits=32768, bits_per_key=1)
    assert got.where("kept").count() == 70


def test_line_dedup(make_docs):
    line = "This line is long enough to count as a repeated line."
    data = [(i, f"first {i}\n  {line.upper() if i % 2 else line}\t\nlast", "en", "a") for i in range(6)]
    data += [(20, None, None, None), (21, "", "en", "a"), (22, "short\nshort", "en", "a"), (22, "short\nshort", "en", "a"), (None, f"{line}\n{line}", "en", "a")]
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.without_repeated_lines(make_docs(data)).collect()}
    assert got == {(i, 3, 1, f"first {i}\nlast") for i in range(5)} | {
        (5, 3, 0, data[5][1]), (20, 1, 0, ""), (21, 1, 0, ""), (22, 2, 0, "short\nshort"), (None, 2, 2, "")}
    assert line_dedup.without_repeated_lines(make_docs(data).limit(0)).count() == 0


def base_spans(text):
    found = []
    for kind, pattern, flags, ok in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        (1, r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), (2, r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    return sorted(found)


def test_secrets(make_docs):
    digest = hashlib.sha256(b"x").hexdigest()
    rng, parts = random.Random(1), "the er ing tion con ment ly an re st in at on en pro com ty al".split()
    ordinary = lambda: " ".join("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(150))
    data = [(i, ordinary() + " somewhat_longer_identifier_name", "en", "a") for i in range(1000, 1300)]
    data += [
        (100, f"é𝄞 Token = '{digest}' and api_key:short and AKIA{'A1' * 9}", "en", "a"), (101, None, None, None), (102, "", None, None),
        (103, "key Zm9vYmFyQmF6MTIzNDU2Nzg5MHF3ZXJ0eVVJT1AxMjM0NTY3ODkw end", "en", "a"), (103, "key Zm9vYmFyQmF6MTIzNDU2Nzg5MHF3ZXJ0eVVJT1AxMjM0NTY3ODkw end", "en", "a"),
        (104, "password=abcdef password=abc token=\"abcdefg", "en", "a"), (105, "-" * 60, "en", "a"), (None, f"{digest} {digest}", "en", "a"),
    ]
    got = secrets.find_secrets(make_docs(data)).collect()
    assert len(got) == len(data)
    texts = dict((i, t or "") for i, t, *_ in data)
    for r in got:
        assert [tuple(s) for s in r["base"]] == base_spans(texts[r["doc_id"]])
    more = {r["doc_id"]: [s["kind"] for s in r["spans"]].count(3) for r in got}
    assert more[103] == 1 and not any(more[i] for i in [*range(1000, 1300), 104, 105])


def test_url_filter(spark):
    urls = [
        None, "no scheme", "http://", "http://A.Example.ORG/es/1?q", "https://example.org/es", "http://example.org/en/12", "http://example.org/en/2#x",
        "http://x.com/fr/", "http://x.com/de/a", "http://evil.example.com/en/", "http://www.evil.example.com", "http://notevil.example.com/", "http://org/", "http://x.com/fr/", "ftp://x.net?://b.org/",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    allow, block = [("org", "/"), ("com", "/fr/")], [("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/de/")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, allow, block, ["evil.example.com"]).collect()}
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for rules, v in ((allow, "allow"), (block, "block")) for h, p in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        bad = host == "evil.example.com" or host.endswith(".evil.example.com")
        best = max(fits, default=(0, None, "block" if bad else "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[1], best[2]), url
    assert url_filter.judge_urls(pages.limit(0), allow, block, []).count() == 0
    assert url_filter.judge_urls(pages, [], [], []).where("verdict <> 'allow'").count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("cast(id as string) AS key")
    listed = universe.where("key % 50 = 0")
    cascade = url_filter.build_cascade(listed, universe, 60)  # far too small a level 0
    assert len(cascade.levels) > 1
    from pyspark.sql import functions as F
    assert universe.where(cascade.contains(F.col("key")) != (F.col("key").cast("int") % 50 == 0)).count() == 0


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain text", "plain text"),
    ("<body><nav><a href=x>Menu</a></nav><article><h1>T &amp; t</h1><p>One,\n two<br>three<p>Four</article><footer>f</footer>", "T & t\n\nOne, two three\n\nFour"),
    ("<div class='comments'><p>nice</p></div><div id=main><p>Long text, with commas, and more of it, here.</p><p>Second one.</p></div><aside><p>side</p></aside>",
     "Long text, with commas, and more of it, here.\n\nSecond one."),
    ("<article><p>Text</p><script>var a='<p>x</p>'</script><form><p>Mail</p></form><ul><li>a<li>b</ul></article>", "Text\n\na\n\nb"),
])
def test_main_text(html, text):
    assert html_main.main_text(html) == text


def test_main_text_of_a_very_long_page(spark):
    body = "".join(f"<p>{prose(i, 20)}</p>" for i in range(3000))
    pages = spark.createDataFrame([(1, "u", f"<article>{body}</article>", "x"), (None, None, None, "x"), (1, "u", "<div>" * 5000 + "deep", "x")], "page_id long, url string, html string, text string")
    got = html_main.extract_main_text(pages).collect()
    assert [r["text"].count("\n\n") for r in got] == [2999, 0, 0] and [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert html_main.extract_main_text(pages.limit(0)).count() == 0


def brute_components(data, percent=80):
    sets = []
    for _, text, *_ in data:
        w = words_of(text)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(data)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, row in enumerate(data):
        ids[find(i)].append((row[0] is None, row[0] or 0, row[0]))
    return sorted(((row[0], len(sets[i]), min(ids[find(i)])[2]) for i, row in enumerate(data)), key=repr)


def edited(words, rng, n):
    words = words[:]
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return words


def test_jaccard_join(make_docs, odd):
    rng, data = random.Random(5), list(odd)
    passage = prose(77, 60)
    for group in range(12):  # around the threshold, and across a limit of the size bands
        base = prose(group, rng.choice([6, 14, 19, 40, 258, 262, 300])).split()
        for _ in range(6):
            n = max(1, len(base) // 45)
            text = edited(base, rng, rng.randint(0, 2 * n)) + prose(rng.random(), rng.randint(0, n)).split()
            data.append((1000 + len(data), " ".join(text), "en", "a"))
    data += [(2000 + i, f"{prose(500 + i, 30)} {passage} {prose(900 + i, 40)}", "en", "a") for i in range(30)]
    docs = make_docs(data)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()), key=repr)
    assert got == brute_components(data)
    kept = jaccard_join.keep_one(make_docs(odd))
    assert kept.columns == docs.columns and jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_components_of_near_copies_that_do_not_all_meet(make_docs):
    """A chain: each text is linked to the next only."""
    words = prose(3, 400).split()
    data = [(i, " ".join(words[i * 12:i * 12 + 150]), "en", "a") for i in range(20)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(make_docs(data)).collect()), key=repr)
    assert got == brute_components(data) and len({c for _, _, c in got}) == 1


@pytest.mark.parametrize("seed", range(4))
def test_keys_of_linked_sets_meet(seed):
    """Every linked pair has a key in common whose counts allow it, and a pair that shares a passage only has none."""
    rng = np.random.default_rng(seed)
    commonness = rng.integers(0, 12, jaccard_join.CELLS).astype(np.uint8)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)

    def meet(x, y):
        found = []
        for s in (x, y):
            keys, before = jaccard_join.sketch_keys(s, commonness, 80)
            found.append(dict(zip(keys.tolist(), before.tolist(), strict=True)))
        allowed = [(found[0][k], found[1][k]) for k in found[0].keys() & found[1].keys() if (found[0][k] + found[1][k]) * 180 <= (len(x) + len(y)) * 20]
        return any(2 * 80 * i <= 20 * len(x) or 2 * 80 * j <= 20 * len(y) for i, j in allowed)

    for n in [1, 2, 4, 5, 9, 13, 15, 16, 17, 40, 100, 200, 255, 256, 300, 1000, 4095, 4096, 5000] * 8:
        base = np.unique(draw(n))
        a = rng.integers(0, n // 9 + 1)  # of either set only
        b = rng.integers(0, n // 9 + 1)
        x, y = np.unique(np.r_[base, draw(a)]), np.unique(np.r_[base, draw(b)])
        if len(base) * 100 >= 80 * len(np.union1d(x, y)):
            assert meet(x, y), (n, a, b)
        inner = np.unique(np.r_[base[len(base) // 9 + 1:], draw(n // 9)])
        if 100 * len(np.intersect1d(inner, base)) >= 80 * len(np.union1d(inner, base)):
            assert meet(inner, base), n
    passage = draw(70)
    commonness[jaccard_join._cells(passage)] = 20
    assert not any(meet(np.unique(np.r_[passage, draw(30)]), np.unique(np.r_[passage, draw(30)])) for _ in range(20))


def test_documents_around_one_passage(make_docs):
    """Many documents share a passage of four in five words, and some are linked by little more than it."""
    passage = " ".join(f"p{i}" for i in range(60))
    data = [(i, passage + " " + " ".join(f"t{i}x{j}" for j in range(i % 14)), "en", "s") for i in range(60)]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(make_docs(data)).collect()}
    assert got == {(i, c) for i, _, c in brute_components(data)}


def test_leaks(spark, make_docs):
    items = [(0, prose(50, 40)), (1, prose(51, 15)), (2, "four words only here"), (3, None), (4, prose(50, 40)), (5, "a b a b a b a b a b a b")]
    broken = items[0][1].split()
    broken[39] = "changed"
    data = [
        (1, f"{prose(60, 300)} {items[0][1].upper()} {prose(61, 5)}", "en", "a"), (2, " ".join(broken), "en", "a"), (3, items[1][1], "en", "a"), (3, items[1][1], "en", "a"),
        (4, prose(62, 500), "en", "a"), (5, None, None, None), (6, "", "en", "a"), (7, " ".join(items[0][1].split()[:20]), "en", "a"),
        (8, "four words only here", "en", "a"), (None, "x " + items[5][1] + " y", "en", "a"), (9, prose(63, 30_000) + " " + items[1][1], "en", "a"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs(data)
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark).collect()), key=repr)
    expected = []
    for doc_id, text, *_ in data:  # every window of every item's size
        w = words_of(text)
        for item_id, item in items:
            t = words_of(item)
            if len(t) < 5 or len(w) < 5:
                continue
            want, n = Counter(tuple(t[k:k + 5]) for k in range(len(t) - 4)), min(len(t), len(w))
            hit = False
            for s in range(len(w) - n + 1):
                have = Counter(tuple(w[k:k + 5]) for k in range(s, s + n - 4))
                both = sum((have & want).values())
                hit = hit or both and both >= 0.8 * (sum(have.values()) + sum(want.values()) - both)
            if hit:
                expected.append((doc_id, item_id))
    assert got == sorted(expected, key=repr)
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i in {4, 5, 6, 7, 8})
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0 and decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


def test_mixing(make_docs, odd):
    rng = random.Random(3)
    data = [(i, "x" * rng.randint(1, 9), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(6000)]
    docs = make_docs(data)
    weights = {"a": 1.0, "b": 2.0, None: 1.0, "gone": 5.0}
    copies = mixing.mixed(docs, weights).select("doc.doc_id", "doc.text", "doc.source", "copy").collect()
    total = sum(len(t) for _, t, *_ in data)
    for source, share in (("a", 0.25), ("b", 0.5), (None, 0.25)):
        assert abs(sum(len(r["text"]) for r in copies if r["source"] == source) / total - share) < 0.04
    again = mixing.mixed(docs.repartition(7), weights).select("doc.doc_id", "doc.text", "doc.source", "copy").collect()
    assert again == copies
    assert mixing.mixed(docs.limit(0), weights).count() == 0 and mixing.mixed(make_docs(odd), {"a": 0.0}).where("doc.source = 'a'").count() == 0


@pytest.mark.parametrize("rate", [0.1, 1.0, 7.5, 480.0])
def test_poisson_inverse(spark, rate):
    from pyspark.sql import functions as F
    us = [0.0, 0.01, 0.3, 0.5, 0.9, 0.999]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").coalesce(1).select(mixing.poisson_inverse(F.col("u"), F.lit(rate))).collect()]
    for u, n in zip(us, got):
        p, below, k = math.exp(-rate), math.exp(-rate), 0
        while below <= u:
            k += 1
            p *= rate / k
            below += p
        assert n == k


def test_language_id(spark, make_docs, odd):
    samples = {"en": "the house and the garden of the old man", "de": "das Haus und der Garten des alten Mannes", "fr": "la maison et le jardin du vieil homme"}
    labelled = make_docs([(i, text, lang, "a") for i, (lang, text) in enumerate(samples.items())] + [(9, None, "en", "a"), (10, "x", None, "a")])
    profiles = language_id.learn_profiles(labelled)
    assert sorted(profiles) == ["de", "en", "fr"]
    texts = make_docs([(0, "the man and the house", None, "a"), (1, "der Mann und das Haus", None, "a"), (2, "le jardin et la maison", None, "a"), *odd])
    got = language_id.predict_languages(texts, profiles).collect()
    assert [r["lang_pred"] for r in got[:3]] == ["en", "de", "fr"] and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc"]["doc_id"] for r in got[3:] if r["lang_pred"] == "und"} == {1, 2, 3, 12}
    assert language_id.reject_unknown(texts, profiles).columns == texts.columns
    assert language_id.learn_profiles(labelled.limit(0)) == {}
    assert {r["lang_pred"] for r in language_id.predict_languages(texts, {}).collect()} == {"und"}


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Été à la plage, 12 fois! " * 40 + "fin"
    whole = language_id._text_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 17)
    pieces = language_id._text_counts(text)
    assert np.array_equal(whole[0], pieces[0]) and np.array_equal(whole[1], pieces[1])


def test_lm_scores(spark, make_docs, odd):
    from pyspark.sql import functions as F
    got = lm_score.score_texts(make_docs(odd), F.col("doc_id") % 3 == 0).collect()
    train = [words_of(t) + [None] for i, t, *_ in odd if not (i is not None and i % 3 == 0)]
    # a null id is neither: the flag is null and the row is not held out
    c = Counter(w for d in train for w in d)
    pairs = Counter(p for d in train for p in zip([0, *d], d))
    n, v = sum(c.values()), len(c)
    texts = defaultdict(list)
    for i, t, *_ in odd:
        texts[i].append(words_of(t) + [None])
    assert len(got) == len(odd)
    for r in got:
        d = texts[r["doc_id"]][0]
        alone = [(c[w] + 1) / (n + v + 1) for w in d]
        score = sum(math.log10((pairs[p] + lm_score.MU * a) / ((c[p[0]] if p[0] != 0 else c[None]) + lm_score.MU)) for p, a in zip(zip([0, *d], d), alone))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(d), sum(c[w] > 0 for w in d), n)
        assert math.isclose(r["base_score"], sum(map(math.log10, alone)), rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=0.01, abs_tol=0.02)
    assert lm_score.score_texts(make_docs(odd).limit(0), F.lit(False)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1 << 40)), st.lists(st.integers(0, 1 << 41)))
def test_elias_fano(values, queries):
    values = np.array(sorted(values), dtype=np.uint64)
    ef = EliasFano(values, 1 << 40, MappedFile())
    assert np.array_equal(ef.at(np.arange(len(values))), values)
    if len(values):
        asked = np.array([*values.tolist(), *queries], dtype=np.uint64)
        found = ef.find(asked, 0, len(values))
        assert [(int(x) in set(values.tolist())) for x in asked] == [bool(i >= 0 and values[i] == x) for i, x in zip(found, asked)]


@settings(deadline=None, max_examples=40)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 40))))
def test_trie(pairs):
    keys = np.array(sorted(a << 32 | b for a, b in pairs), dtype=np.uint64)
    trie = NgramTrie(keys, np.arange(len(keys)) % 250 + 1)
    asked = np.array(sorted(a << 32 | b for a in range(11) for b in range(42)), dtype=np.uint64)
    wanted = {int(k): i % 250 + 1 for i, k in enumerate(keys)}
    assert trie.look_up(asked).tolist() == [wanted.get(int(k), 0) for k in asked]
