"""The operators against brute force, exact round trips and awkward rows."""

import base64
import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinlab.llm import _text as text_kernels
from skeinlab.llm import byte_bpe, fingerprints, license_scan, mixing, ngram_jaccard, quality_classifier, quality_rules, substring_dedup, token_counts, url_templates
from skeinlab.llm.queries import ORACLE_SQL, QUERIES, held_out, tokenizer_file

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "one two", "one two", "é ñ\n\nß x's don't 'search  12 34\t", "<|endoftext|>a <|startoftext|>", "x" * 5000, "İstanbul Σ é", "The license: CC BY-NC 4.0, all rights\nreserved.", "日本語 👍🏽 '"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, None if i % 3 else "en", "s", 7, "clash") for i, t in enumerate(ODD)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def empty(df):
    return df.filter(F.lit(False))


def test_jaccard_finds_every_link(docs, odd):
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = r.text.split()
        sets[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links, parent = collections.Counter(), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard.join(docs).collect()}
    assert got == {i: (root(i), links[i]) for i in ids} and sum(links.values())
    out = ngram_jaccard.join(odd).collect()
    assert len(out) == odd.count() and sorted(r.n_links for r in out if r.doc_id in (4, 5)) == [2, 2, 2]
    assert ngram_jaccard.join(empty(docs)).count() == 0


def test_jaccard_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {}
    for r in docs.collect():
        w = (r.text or "").split()
        if w:
            own[r.doc_id] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    assert len(own) >= 900
    ids, links = sorted(own), collections.Counter()
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if 5 * min(len(own[i]), len(own[j])) >= 4 * max(len(own[i]), len(own[j])):
                both = len(own[i] & own[j])
                if 5 * both >= 4 * (len(own[i]) + len(own[j]) - both):
                    links[i] += 1
                    links[j] += 1
    got = {r.doc_id: r.n_links for r in ngram_jaccard.join(docs).collect()}
    assert all(got[i] <= links[i] for i in ids) and sum(got.values()) >= 0.99 * sum(links.values()) > 100


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    monkeypatch.setattr(ngram_jaccard, "BRUTE", 8)
    monkeypatch.setattr(ngram_jaccard, "DEPTH", 2)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(40)]
    got = ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 39)}


def test_keep_one_goes_by_rows(spark, odd):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (7, a, "s"), (8, f"{c} end", "t"), (9, c, "u"), (1, a, "v"), (None, a, "w"), (2, None, "x"), (2, "", "y"), (3, " ", "z"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    out = ngram_jaccard.keep_one(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(1, a), (5, b), (8, f"{c} end"), (0, a), (2, ""), (2, ""), (3, " "), (4, "")])
    assert ngram_jaccard.keep_one(odd).columns == odd.columns and ngram_jaccard.keep_one(empty(df)).count() == 0


def test_buckets_are_linked_as_by_all_pairs():
    rng = np.random.default_rng(1)
    path = np.sort(rng.integers(0, 60, 1500))
    path[200:500] = path[200]
    path = np.sort(path)
    brief = rng.integers(0, 256, (30, ngram_jaccard.TOKENS), np.uint8)[rng.integers(0, 30, len(path))]
    noise = rng.random(brief.shape) < 0.25
    brief = np.where(noise, rng.integers(0, 256, brief.shape, np.uint8), brief)
    i, j = np.nonzero(np.triu((path[:, None] == path[None, :]) & ((brief[:, None] == brief[None, :]).sum(2) >= 36), 1))
    want = ngram_jaccard._forest(len(path), i, j)
    row, root = ngram_jaccard._link(path, brief, 36)
    got = np.arange(len(path))
    got[row] = root
    assert (got == want).all() and len(row) > 100


def test_quality_rules_base(docs, odd):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for df in (docs, odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in quality_rules.judge(df).collect():
            t = texts[r.doc_id]
            w, runs = word.findall(t), collections.defaultdict(list)
            for k in range(len(w) - 4):
                runs[tuple(w[k : k + 5])].append(k)
            covered = {p + j for v in runs.values() if len(v) > 1 for p in v for j in range(5)}
            lines = [x for x in t.split("\n") if word.search(x)]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
            assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(empty(docs)).count() == 0


def test_license_base_and_templates(spark, docs, odd):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.scan(docs).collect():
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        places = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places)) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
    got = {r.doc_id: r for r in license_scan.scan(odd).collect()}
    assert got[10].labels == "cc-by,cc-by-nc-4.0,reserved" or {"cc-by", "reserved"} <= set(got[10].labels.split(","))
    assert got[0].n_words == 0 and got[0].score == 0
    assert license_scan.scan(empty(docs)).count() == 0


def test_urls(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/1?q", "http://x.net", "http://net/x", "https://b.example.com/de/9#t", "https://b.example.org/fr/", "https://b.example.org/es/"]
    got = {r.page_id: r for r in url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i].rule for i in range(8)] == [None, None, "example.net/en/", None, "net/", "example.com/de/", "org/fr/", None]
    assert (got[2].host, got[2].path, got[2].verdict) == ("a.example.net", "/en/1", "allow")
    assert (got[0].host, got[0].path, got[0].verdict) == ("", "", "allow") and got[5].verdict == "block"
    labelled = [(i, f"http://h.test/bad/{i}") for i in range(30)] + [(i, f"http://h.test/good/{i}") for i in range(30, 60)]
    pages = spark.createDataFrame(labelled, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(20)] + [(i, 0) for i in range(30, 50)], "page_id long, label int")
    verdicts = {r.page_id: r.verdict for r in url_templates.judge(pages, {}, labels).collect()}
    assert all((verdicts[i] == "block") == (i < 30) for i in verdicts)
    assert url_templates.judge(empty(pages)).count() == 0
    rows = [(None, None, "x", "y"), (1, "http://a.test/x", "x", "y"), (1, "http://a.test/x", "x", "y"), (2, "http://a.test/" + "d/" * 8 + "9", "x", "y")]
    out = url_templates.judge(spark.createDataFrame(rows, "page_id long, url string, host string, template string"))
    assert len(set(out.columns)) == len(out.columns) and out.count() == 4


def test_url_tree_is_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").collect()]
    deep = [f"https://shop.test/{a}/{b}/{k}" for a in ("poker", "books", "toys") for b in ("x", "y") for k in range(9)] + [f"https://wide.test/poker-{chr(97 + k // 26)}{chr(97 + k % 26)}/end" for k in range(40)]
    mixed = [f"https://mix.test/{'poker' if k % 2 else 'chess'}/{'ab'[k // 20]}/{k}" for k in range(40)]
    pages += [(10**6 + i, u) for i, u in enumerate([*deep, *mixed, None, "nothing", None])]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.template) for r in url_templates.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}

    def facts(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = host.lower()
        fits = [r for r in url_templates.RULES if (host == (n := r.split("/", 1)[0]) or host.endswith("." + n)) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        bad = url_templates.RULES[rule] == "block" if rule else bool(set(re.findall("[a-z]+", f"{host}{path}".lower())) & set(url_templates.WORDS))
        return host, path, rule, int(bad), tuple("*" if re.search(r"\d", s) or len(s) > 40 else s for s in path.split("/") if s)

    rows = {p: facts(u) for p, u in pages}
    now = {p: r[4] for p, r in rows.items()}
    depth = max(map(len, now.values()))
    for level in range(depth):
        children = collections.defaultdict(list)
        for p, t in now.items():
            if len(t) > level and t[level] != "*":
                children[rows[p][0], t[:level]].append(t[level])
        varied = {k for k, v in children.items() if len(set(v)) > 20 and len(set(v)) >= 0.5 * len(v)}
        now = {p: (*t[:level], "*", *t[level + 1 :]) if len(t) > level and (rows[p][0], t[:level]) in varied else t for p, t in now.items()}
    for level in reversed(range(depth)):
        own = collections.defaultdict(list)
        for p, t in now.items():
            own[rows[p][0], t].append(rows[p][3])
        pools = collections.defaultdict(list)
        for (h, t), v in own.items():
            if len(t) > level:
                pools[h, (*t[:level], "(*)", *t[level + 1 :])].append((t, v))
        moved = {}
        for (h, w), group in pools.items():
            n, b = sum(len(v) for _, v in group), sum(sum(v) for _, v in group)
            for t, v in group if len(group) > 1 else []:
                o, share = n - len(v), b / n
                if not abs(sum(v) / len(v) - (b - sum(v)) / o) > 1.96 * (share * (1 - share) * (1 / len(v) + 1 / o)) ** 0.5:
                    moved[h, t] = w
        now = {p: moved.get((rows[p][0], t), t) for p, t in now.items()}
    prior = sum(r[3] for r in rows.values()) / len(rows)
    own = collections.defaultdict(list)
    for p, t in now.items():
        own[rows[p][0], t].append(rows[p][3])
    rejected = {k for k, v in own.items() if len(v) >= 5 and (sum(v) + 2 * prior) / (len(v) + 2) >= 0.9}
    want = {p: (*r[:3], url_templates.RULES[r[2]] if r[2] else "block" if (r[0], now[p]) in rejected else "allow", "/".join(now[p])) for p, r in rows.items()}
    assert got == want
    blocked = {r[0] for r in want.values() if r[2] is None and r[3] == "block"}
    assert {"free-bets.example.com", "shop.test", "wide.test"} <= blocked and not any(r[3] == "block" for r in want.values() if r[2] is None and (r[0] == "blog.tionsh.example.com" or "/chess/" in r[1]))


def test_mixing_meets_targets(docs, odd):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 < r.probability <= 1 for r in rows)
    own, drawn = collections.Counter(), collections.Counter()
    for r in rows:
        own[r.source] += r.tokens
        drawn[r.source] += r.tokens * r.probability
    goal = {s: n**0.8 for s, n in own.items()}
    assert all(abs(drawn[s] / sum(drawn.values()) - goal[s] / sum(goal.values())) < 1e-4 for s in own)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty(docs)).count() == 0


def test_classifier_holds_out(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality_classifier.train(texts, labels.filter(~held_out()))
    rows = quality_classifier.score(texts, model).join(labels, "doc_id").filter(held_out()).collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) > 0.97 * len(good) * len(bad)
    nothing = quality_classifier.score(docs, quality_classifier.train(docs, empty(labels)))
    assert {r.score for r in nothing.collect()} == {0.5}


def test_substring_dedup(spark, odd, docs):
    passage = " ".join(f"word{k}." if k % 6 == 5 else f"word{k}" for k in range(60))
    rows = [(1, f"First one here.\n{passage} Tail of one."), (2, f"Another start.\n{passage}\nAnd more text."), (3, "Clean text, nothing shared. At all."), (3, "Another text with that id."), (None, passage), (4, None)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    assert by[1] == [rows[0][1]] and "word30" not in by[2][0] and by[2][0].startswith("Another start.") and "And more text." in by[2][0]
    assert sorted(by[3]) == sorted([rows[2][1], rows[3][1]]) and by[None] == [passage] and by[4] == [None]
    assert substring_dedup.dedup(odd).count() == odd.count() and substring_dedup.dedup(empty(docs)).count() == 0


def test_substring_dedup_is_every_run(spark, docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def cut(text):
        out, own, words = [], [], list(word.finditer(text))
        for k, m in enumerate(words):
            own.append(m[0])
            gap = text[m.end() : words[k + 1].start()] if k + 1 < len(words) else "\n"
            if re.search(r"""[.!?]["')\]}]{0,2}$""", m[0]) or "\n" in gap:
                out.append(own)
                own = []
        return out

    def brute(texts, least=24, most=120):
        sents, seen, gone = {d: cut(t) for d, t in texts.items()}, set(), {}
        for d in sorted(sents):
            own, gone[d] = sents[d], set()
            for i in range(len(own)):
                run = []
                for j in range(i, len(own)):
                    run += own[j]
                    if len(run) >= least and j > i:
                        if tuple(run) in seen:
                            gone[d].update(range(i, j + 1))
                        seen.add(tuple(run))
                        if len(run) > most:
                            break
        return {d: (len(sents[d]), len(gone[d])) for d in sents}

    def passage(*sizes):
        return " ".join(" ".join(f"p{n}w{k}" for k in range(n)) + "." for n in sizes)

    rows = [(1, f"First one here. {passage(5, 24, 23)} Tail of one."), (2, f"Another start. {passage(5, 24, 23)} More text."), (3, passage(9, 10, 11, 12, 4)), (4, passage(9, 10, 11, 12, 4))]
    rows += [(5, f"One alone. {passage(30)} Not several."), (6, f"Alone too. {passage(30)} At all."), (7, f"A. {passage(7, 6, 8, 6)} B."), (8, f"C. {passage(7, 6, 8, 6)} D.")]
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[6].n_removed == 0 and got[8].text == "C. D."
    short = [(1, f"A. {passage(5, 4, 3)} B."), (2, f"C. {passage(5, 4, 3)} D."), (2, passage(5, 4, 3)), (2, passage(5, 4, 3)), (2, None)]
    assert sorted(r.text or "" for r in substring_dedup.dedup(spark.createDataFrame(short, "doc_id long, text string"), 3, 0).collect()) == ["", "", "", f"A. {passage(5, 4, 3)} B.", "C. D."]
    long = [(1, " ".join(passage(k % 7 + 4) for k in range(300_000))), (2, f"A start. {passage(*range(4, 11))} An end."), (2, "x"), (2, f"A start. {passage(*range(4, 11))} An end.")]
    out = substring_dedup.dedup(spark.createDataFrame([(*r, "clash") for r in long], "doc_id long, text string, n_removed string")).filter("doc_id = 2").collect()
    assert sorted(r.text for r in out) == ["A start. An end.", "A start. An end.", "x"]
    assert got[2].text == "Another start. More text." and got[4].text == "" and {d: (r.n_sentences, r.n_removed) for d, r in got.items()} == brute(dict(rows))
    assert {r.doc_id: (r.n_sentences, r.n_removed) for r in substring_dedup.dedup(docs).collect()} == brute({r.doc_id: r.text for r in docs.collect()})


def test_fingerprints_of_edited_texts(docs, odd):
    for df in (docs, odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
        got = {r.doc_id: r for r in fingerprints.compare_edited(df).collect()}
        assert len(got) == len(rows)
        for i, (d, t) in enumerate(rows):
            q = len(t) // 4
            edited = t[: len(t) - q] + rows[(i + 1) % len(rows)][1][:q]
            assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        if df is docs:  # a text of one letter has one anchor, so nothing is claimed of the others
            words = {r.doc_id: len(set(r.text.split())) for r in docs.collect()}
            assert all(r.near_edited > 0.3 for d, r in got.items() if words[d] > 100)
    same = {}
    for r in fingerprints.fingerprint(docs).join(docs, "doc_id").collect():
        assert same.setdefault(r.text, r.fingerprint) == r.fingerprint
    assert fingerprints.compare_edited(empty(docs)).count() == 0


def test_fingerprints_keep_every_anchor(spark, docs):
    def chain(x, y):
        row = [0] * (len(y) + 1)
        for v in x:
            new = [0]
            for j, w in enumerate(y):
                new.append(row[j] + 1 if v == w else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def own(text):
        data = text.encode()
        inner = [int(h) for h in (fingerprints.X.mix64(np.array([int.from_bytes(data[i : i + 6], "little") for i in range(len(data) - 5)], np.uint64)) >> np.uint64(32))]
        places = [p for p in range(len(data) - 15) if min(inner[p : p + 11]) in (inner[p], inner[p + 10])]
        return places, [data[p : p + 16] for p in places]

    shared = " ".join(f"passage{k}" for k in range(12))
    long = [" ".join(f"{c}{k * 7919 % 10007}" for k in range(600)) for c in "abcd"]
    made = [(1, f"{long[0]} {shared} {long[1]}"), (2, f"{long[2]} {shared} {long[3]}"), (3, "ab" * 300), (4, "ab" * 200), (5, "one line, again and again. " * 40), (6, "one line, again and again. " * 30 + "Then an end of its own.")]
    for df in (spark.createDataFrame(made, "doc_id long, text string"), docs.filter("char_length(text) BETWEEN 600 AND 1500")):
        rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        got = {r.doc_id: r for r in fingerprints.compare_edited(df).collect()}
        for i, (d, t) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            words = np.frombuffer(base64.b64decode(got[d].fingerprint), "<u4")
            places, x = own(t)
            assert words[len(words) // 2 :].tolist() == places and len(words) == 2 * len(places)
            for value, y in ((got[d].near_edited, own(t[: len(t) - len(t) // 4] + after[: len(t) // 4])[1]), (got[d].near_next, own(after)[1])):
                a, b = collections.Counter(x), collections.Counter(y)
                assert value == pytest.approx(chain(x, y) / (a | b).total())
        if len(rows) == len(made):
            assert got[1].near_next > 0


def awkward(spark, long):
    """Every code point, random mixtures, words of made hash collisions, and long texts."""
    rng = np.random.default_rng(3)
    points = text_kernels.ALL_POINTS
    pool = ["'s", "'", "’s", " ", "  ", "\n", "a", "Z", "é", "1", "٣", "日", "\u0301", "'ll", "<|endoftext|>", "\xa0", "　", "İ", "\u20d9", "\u1bae", "각", "ᄀ", "ᅡ", "Σ", "\U0001e5ed", "ǰ", "\U00013808"]
    made = [" ".join(points[i + k : i + k + 7] for k in range(0, 5000, 7)) for i in range(0, len(points), 5000)]
    made += ["".join(pool[k] if k < len(pool) else points[rng.integers(len(points))] for k in rng.integers(0, len(pool) + 3, 25)) for _ in range(3000)]
    tm = "a"
    for _ in range(10):
        tm += tm.translate(str.maketrans("ab", "ba"))
    made += [tm, tm.translate(str.maketrans("ab", "ba")), "a" * 70_000, " " * 30_000 + "x" + "\n" * 500, "aab" * 9_000, "İ" + " \u0301" * 10]
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    made += ["\n".join("".join(r) for r in letters[rng.integers(0, 52, (long, 76))]), "x's  y " * (long * 8)]
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(made)], "doc_id long, text string, n_tokens string, n_bytes int").repartition(8)


def test_byte_bpe_is_the_library(spark, docs, odd):
    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(path), special_tokens={})
    for df in (docs, odd, awkward(spark, 55_000)):
        out = byte_bpe.encode(df, path, ids=True)
        assert len(set(out.columns)) == len(out.columns)
        for r in out.collect():
            ids = library.encode_ordinary(r.text or "")
            assert r.token_ids == " ".join(map(str, ids)) and r.n_tokens == len(ids)
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.encode(empty(docs), path).count() == 0


def test_a_worker_drops_the_tokenizer_before_another_kernel():
    def run(free=None):
        return list(text_kernels.tidy(lambda batches: batches, free)(iter(())))

    run(byte_bpe.forget)
    byte_bpe.Encoder.of(tokenizer_file("byte_bpe_50k.tiktoken"))
    run(byte_bpe.forget)
    assert byte_bpe.Encoder._held  # tasks of one kernel share it
    run()
    assert not byte_bpe.Encoder._held


def test_token_counts_are_the_library(spark, docs, odd):
    path = tokenizer_file("word_bpe_49k.json")
    library = token_counts.tokenizer(path)
    for df in (docs, odd, awkward(spark, 30_000)):
        out = token_counts.count(df, path)
        assert len(set(out.columns)) == len(out.columns)
        for r in out.collect():
            assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids), (r.text or "")[:200]
            assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 2048)
    assert token_counts.count(empty(docs), path).count() == 0


def test_long_spans_hash_apart():
    tm = np.array([0], np.uint8)
    for _ in range(12):
        tm = np.concatenate([tm, 1 - tm])
    values = text_kernels.BYTE_VALUES[np.concatenate([tm, 1 - tm, tm])]
    n = len(tm)
    h = text_kernels.span_hashes(values, np.array([0, n, 2 * n, 0]), np.array([n, 2 * n, 3 * n, 300]))
    assert h[0] == h[2] != h[1] and h[3] == text_kernels.span_hashes(values[:300], np.array([0]), np.array([300]))[0]


def test_quality_distances_are_brute_force(docs):
    import regex

    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = {r.doc_id: r for r in docs.collect()}
    classes, words = {}, {}
    for d, r in rows.items():
        own, common = word.findall(r.text), quality_rules.COMMON_WORDS.get(r.lang, [])
        chars = sum(map(len, own))
        parts = [len(regex.findall(p, r.text)) for p in (r"\p{Lu}", "[0-9]", r"""[.,;:!?'"()-]""", r"[#*$%&|<>]")]
        classes[d] = [chars - sum(parts), parts[0], parts[1], len(r.text) - chars, *parts[2:]]
        low = collections.Counter(w.lower() for w in own)
        words[d] = [low[c] for c in common] + [len(own) - sum(low[c] for c in common)]

    def distance(x, y):
        p, q = (np.array(v, float) / max(1, sum(v)) for v in (x, y))
        m = (p + q) / 2
        return sum((v[v > 0] * np.log2(v[v > 0] / m[v > 0])).sum() for v in (p, q)) / 2

    sums = {lang: tuple(np.sum([x[d] for d in rows if rows[d].lang == lang], axis=0) for x in (classes, words)) for lang in {r.lang for r in rows.values()}}
    for r in quality_rules.judge(docs).collect():
        one, two = (max(0, distance(x[r.doc_id], ref)) ** 0.5 for x, ref in zip((classes, words), sums[rows[r.doc_id].lang], strict=True))
        assert (r.class_distance, r.word_distance) == (pytest.approx(one, abs=1e-6), pytest.approx(two, abs=1e-6))
        near = r.n_words < quality_rules.GUARD or (one <= quality_rules.MOST_CLASS and (one <= quality_rules.DOUBT_CLASS or two <= quality_rules.DOUBT_WORD))
        assert r.kept == (near and not r.base_failed)


def test_license_labels_are_brute_force(spark, docs):
    index = license_scan.Index()
    made = [(10**6 + k, f"Some words here. {text.title()}, and so on.") for k, (_, text, _) in enumerate(license_scan.TEMPLATES)] + [(2 * 10**6, "license " * 2000), (2 * 10**6, "license " * 2000), (None, None)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    seen = set()
    for r in license_scan.scan(df).join(df.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "d"), F.expr("doc_id <=> d")).collect():
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        want, best = set(r.base_labels.split(",")) - {""}, 0.5 if r.n_base else 0.0
        shares = []
        for (label, text, phrases), (_, hashes, _), weight in zip(license_scan.TEMPLATES, index.templates, index.weight, strict=True):
            t = text.split()
            for start in range(-len(t), len(w)) if len(w) < 500 else ():
                share = sum(index.idf[h] for i, (x, h) in enumerate(zip(t, hashes, strict=True)) if 0 <= start + i < len(w) and w[start + i] == x) / weight
                near = f" {' '.join(w[max(0, start - 3) : max(0, start + len(t) + 3)])} "
                if share >= license_scan.LEAST_SHARE and all(f" {p} " in near for p in phrases):
                    want.add(label)
                    shares.append(share)
        if len(w) < 500:
            assert r.labels == ",".join(sorted(want)) and r.score == pytest.approx(min(1.0, max(shares, default=best)))
        seen |= want
    assert {label for label, _, _ in license_scan.TEMPLATES} <= seen


def test_mixing_meets_every_marginal(spark, docs, odd):
    rows = mixing.mix(docs).collect()
    for key in ("source", "lang", "mix_topic"):
        own, drawn = collections.Counter(), collections.Counter()
        for r in rows:
            own[r[key]] += r.tokens
            drawn[r[key]] += r.tokens * r.weight
        goal = {k: n**0.8 for k, n in own.items()}
        assert all(abs(drawn[k] / sum(drawn.values()) - goal[k] / sum(goal.values())) < 1e-4 for k in own)
    assert {r.deviation < 1e-4 for r in rows} == {True}
    two = spark.createDataFrame([(1, "a b", "p", "en", "t"), (2, "c d", "q", "de", "t"), (3, None, "r", None, "t")], "doc_id long, text string, source string, lang string, topic string")
    shares = {"source": spark.createDataFrame([("p", 0.9), ("q", 0.1)], "value string, share double"), "lang": spark.createDataFrame([("en", 0.1), ("de", 0.9)], "value string, share double")}
    assert all(r.deviation > 0.1 for r in mixing.mix(two, shares).collect())
    none = mixing.mix(odd.withColumn("text", F.lit(None).cast("string"))).collect()
    assert {(r.probability, r.kept, r.tokens) for r in none} == {(1.0, True, 0)} and len(none) == odd.count()


def test_classifier_takes_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (5, 0), (5, 0), (6, None), (None, 1), (7, 1), (7, 0)], "doc_id long, quality int")
    model = quality_classifier.train(odd.unionByName(odd).unionByName(odd), labels)
    assert (model.weights == quality_classifier.train(odd, labels).weights).all()
    out = quality_classifier.score(odd, model)
    assert out.columns.count("score") == 1 and out.count() == odd.count()
    scores = {r.text: r.score for r in out.collect()}
    assert scores[None] == scores[""] == scores[" "] == pytest.approx(1 / (1 + np.exp(-model.intercept)))
    for text, score in scores.items():
        data = np.frombuffer((text or "").encode(), np.uint8)
        assert score == pytest.approx(quality_classifier.dot(model, text_kernels.Texts(data, np.array([0, len(data)])))[0])


def test_pipeline(spark, odd):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    whole = spark.read.parquet(f"{SF}/documents.parquet")
    docs = corpus_pipeline.classify(spark, whole, SF)
    model = quality_classifier.train(whole, spark.read.parquet(f"{SF}/labels.parquet").filter(~held_out()))
    want = [r.doc_id for r in quality_classifier.score(whole, model).collect() if r.score >= 0.7]
    kept = sorted(docs.collect())
    assert docs.columns == whole.columns and sorted(r.doc_id for r in kept) == sorted(want) and 0 < len(kept) < whole.count()

    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in kept if (w := r.text.split())}
    parent = {d: d for d in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(kept, whole.schema), SF)
    kept = sorted(docs.collect())
    assert docs.columns == whole.columns and {r.doc_id for r in kept} == {root(d) for d in sets}

    docs = corpus_pipeline.repeated_spans(spark, spark.createDataFrame(kept, whole.schema), SF)
    before = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(kept, whole.schema)).collect()}
    cut = sorted(docs.collect())
    assert docs.columns == whole.columns and [(r.doc_id, r.text) for r in cut] == sorted((d, r.text) for d, r in before.items() if not r.n_removed or r.text.strip())
    assert all(r.n_chars == len(r.text) for r in cut if before[r.doc_id].n_removed)

    docs = corpus_pipeline.mix(spark, spark.createDataFrame(cut, whole.schema), SF)
    mixed = sorted(docs.collect())
    drawn = [r.doc_id for r in mixing.mix(spark.createDataFrame(cut, whole.schema)).collect() if r.kept]
    assert docs.columns == whole.columns and [r.doc_id for r in mixed] == sorted(drawn) and set(mixed) <= set(cut)

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(tokenizer_file("byte_bpe_50k.tiktoken")), special_tokens={})
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == [r.doc_id for r in mixed]
    assert all(r.token_ids == " ".join(map(str, library.encode_ordinary(r.text))) for r in out)

    for _, stage in corpus_pipeline.STAGES:  # odd rows and none
        got, none = stage(spark, odd, SF), stage(spark, empty(odd), SF)
        assert set(odd.columns) <= set(got.columns) and got.count() <= odd.count() and none.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, folder)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        found = db.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns)
        rows = found.fetchall()
    assert collections.Counter(rows) == collections.Counter(tuple(r) for r in got.select(*names).collect())
