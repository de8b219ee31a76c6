import collections
import math
import re
import zlib

import numpy as np
import pytest

from latentia.llm import katz, language_id, line_dedup, mixing, near_dedup, packing, quality, token_count, url_filter, winnowing

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("byte_bpe_50k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "a", "rho", "sigma", "tau"], n).tolist()) + f" w{rng.integers(1e9)}"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, columns with clashing names."""
    rng = np.random.default_rng(1)
    base = " ".join(words(rng, 3) for _ in range(40))
    texts = [None, "", "   \n\t", "A", base, base, base.upper(), base + " one more", base.replace("alpha", "omega", 1), "x " * 30_000, "naïve façade – 中文字 ½ <|endoftext|> it's", *[words(rng, int(rng.integers(1, 60))) for _ in range(30)]]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s3"][i % 4], None if t is None else len(t), 0.5, "h") for i, t in enumerate(texts)]
    rows += [rows[5], (None, "null id", None, None, 7, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_id(spark, empty):
    rng = np.random.default_rng(0)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "aflqr"}
    rows = [(i, " ".join("".join(rng.choice(list(alphabets[k]), 5)) for _ in range(20)), k) for i, k in enumerate(list(alphabets) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows if i % 5 == 0]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 $$"), (None, "abcde abcde")], "doc_id long, text string")
    out = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[None].lang_pred == "aa" and all(0 <= r.score <= 1 for r in out.values())
    assert language_id.fit(empty) is None and language_id.predict(empty, None).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9])
def test_codewords_differ(n):
    code = language_id.codewords(n)
    assert len({tuple(r) for r in code}) == n and set(np.unique(code)) <= {-1.0, 1.0}


def brute_katz(texts, held):
    t = [[*WORD.findall((x or "").translate(LOWER)), None] for x in texts]
    u, b, h = collections.Counter(), collections.Counter(), collections.Counter()
    for toks, skip in zip(t, held, strict=True):
        if not skip:
            u.update(toks)
            for x, y in zip([0, *toks], toks):
                b[x, y] += 1
                h[x] += 1
    total, distinct = sum(u.values()), len(u)
    low = katz.Unigram(total, dict(collections.Counter(c for c in u.values() if c <= 6)))
    d = katz.good_turing(dict(collections.Counter(c for c in b.values() if c <= 6)))
    p = lambda w: float(low.p(np.array([u[w]]))[0])
    seen = collections.defaultdict(list)
    for (x, y), c in b.items():
        seen[x].append((y, float(katz.discounted(np.array([c]), d)[0])))
    scale = {x: h[x] / (h[x] + 1) if sum(s for _, s in v) >= h[x] - 1e-9 else 1.0 for x, v in seen.items()}
    alpha = {x: (1 - scale[x] * sum(s for _, s in v) / h[x]) / (1 - sum(p(y) for y, _ in v)) for x, v in seen.items()}
    for x, v in list(seen.items())[:20]:  # exactly normalised
        inside = scale[x] * sum(s for _, s in v) / h[x]
        assert inside + alpha[x] * (1 - sum(p(y) for y, _ in v)) == pytest.approx(1, abs=1e-12)
    out = []
    for toks in t:
        s = 0.0
        for x, y in zip([0, *toks], toks):
            c = dict(seen[x]).get(y) if x in seen else None
            s += math.log10(scale[x] * c / h[x]) if c else math.log10(alpha.get(x, 1.0) * p(y))
        out.append((s, len(toks), sum(u[y] > 0 for y in toks), sum(math.log10((u[y] + 1) / (total + distinct + 1)) for y in toks), total))
    return out


@pytest.mark.parametrize("frequent", [0.25, 0.0])
def test_katz_equals_brute_force(spark, docs, empty, frequent, monkeypatch):
    if not frequent:  # every history and bigram that occurs in number is treated as frequent
        monkeypatch.setattr(katz, "FREQUENT", 0.0)
        monkeypatch.setattr(katz, "LEAST_FREQUENT", 40)
    from pyspark.sql import functions as F

    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = df.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute_katz([r.text for r in rows], [r.doc_id % 7 == 2 for r in rows]), strict=True))
    got = {r.doc_id: r for r in katz.score(df, F.col("doc_id") % 7 == 2).collect()}
    assert got.keys() == want.keys()
    for i, (s, n, known, base, total) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.score == pytest.approx(s, rel=1e-9) and r.base_score == pytest.approx(base, rel=1e-9)
    assert katz.score(docs, F.lit(False)).count() == docs.count() and katz.score(empty, F.lit(False)).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme/x", "http://COM", "http://Com/", "https://a.example.com/en/1?q", "https://www.example.com/en/", "http://x.www.example.com/en/x", "http://y.net/es/", "http://net/fr/1#z", "http://y.net/e", "http://ads-track.example.org/q", "http://notcom/", "http://other.org/", "ftp://u:p@com:80/x"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(5, urls[5], "z")], "page_id long, url string, host string")
    for literal in (url_filter.LITERAL_WORDS, 0):
        out = url_filter.judge(df.drop("host"), url_filter.listed_entries(spark), literal_words=literal)
        got = sorted((r.page_id, r.list_host or "", r.list_verdict or "") for r in out.collect())
        assert len(got) == len(urls) + 1
        best = {i: (h, v) for i, h, v in got}
        assert best[3] == ("", "") and best[4] == ("com", "allow") and best[5] == ("example.com", "block") and best[6] == ("www.example.com", "allow")
        assert best[7] == ("www.example.com", "allow") and best[8] == ("net", "block") and best[9] == ("net", "block") and best[10] == ("", "") and best[11] == ("ads-track.example.org", "block")
        assert all(best[i] == ("", "") for i in (0, 1, 2, 12, 13, 14))


def test_url_filter_with_a_long_list_against_brute_force(spark):
    rng = np.random.default_rng(3)
    listed = {(f"h{rng.integers(3000)}.{rng.choice(['com', 'net', 'x.org'])}", "/" + "p" * int(rng.integers(0, 90))): str(rng.choice(["allow", "block"])) for _ in range(9000)}
    rows = [(h, p, v, "site") for (h, p), v in listed.items()]
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}h{rng.integers(6000)}.{rng.choice(['com', 'net', 'x.org'])}/{'p' * int(rng.integers(0, 100))}{rng.choice(['', '/q', '?z'])}" for _ in range(2000)]

    def best(host, path):
        labels, fits = host.split("."), []
        for i in range(len(labels)):
            h = ".".join(labels[i:])
            fits += [(h, path[:n]) for n in range(1, len(path) + 1) if (h, path[:n]) in listed]
        return max(fits, key=lambda e: (len(e[0] + e[1]), len(e[0])), default=(None, None))

    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    entries = spark.createDataFrame(rows, "host string, path string, verdict string, kind string")
    for literal in (url_filter.LITERAL_WORDS, 0):
        got = url_filter.judge(df, entries, literal_words=literal).collect()
        assert len(got) == len(urls) and sum(r.list_host is not None for r in got) > 300
        for r in got:
            want = best(r.host, r.path)
            assert (r.list_host, r.list_path) == want and r.list_verdict == listed.get(want)


def test_bloom_has_no_false_negative(spark):
    from pyspark.sql import functions as F

    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    bloom = url_filter.BlockedBloom(3000)
    probe = spark.range(9000).select(F.col("id"), F.col("id").cast("string").alias("k"))
    hit = probe.join(bloom.table(keys, "k"), bloom.word(F.col("k")) == F.col("word")).where(F.col("mask").bitwiseAND(bloom.mask(F.col("k"))) == bloom.mask(F.col("k")))
    assert hit.where("id < 3000").count() == 3000 and hit.where("id >= 3000").count() < 600


def test_tokens_and_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = docs.select("doc_id", "text").collect()
    ids = [t.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    got = token_count.count_tokens(docs, PATH).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len((r.text or "").encode()), len(x)) for r, x in zip(rows, ids, strict=True))
    want = collections.Counter()
    for r, x in zip(rows, ids, strict=True):  # every piece: the first may be shorter, the others are full
        x, start = [*x, 2], 0
        for k in range(-(-len(x) // 1024)):
            length = (len(x) % 1024 or 1024) if not k else 1024
            want[r.doc_id, k, start, length, zlib.crc32(np.array(x[start : start + length], "<u4").tobytes())] += 1
            start += length
    out = packing.pack(docs, PATH).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty, PATH).count() == 0 and token_count.count_tokens(empty, PATH).count() == 0


def test_merging_overlaps():
    m, s = token_count.Merger(PATH), token_count.Splitter(PATH)
    pieces = ["aaaaaaa", "    ", "zzzzzzzzzzzz", "=" * 77, "a", " the"]
    assert m.counts([p.encode() for p in pieces]).tolist() == [len(s.tokenizer.encode(p).ids) for p in pieces]


def best_fit_decreasing(h, capacity=1024):
    rooms = []
    for length in sorted(h, reverse=True):
        for _ in range(h[length]):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("low, high, n", [(1, 1025, 1500), (1, 1025, 300), (200, 700, 1000), (300, 360, 500)])
def test_plan_uses_every_piece_once_and_few_sequences(low, high, n):
    rng = np.random.default_rng(5)
    h = collections.Counter(rng.integers(low, high, n).tolist())
    plan, by_program = packing.plan_sequences(h, 1024)
    used = collections.Counter()
    for filling, times in plan:
        assert packing.filled(filling) <= 1024
        for x, a in filling:
            used[x] += a * times
    assert used == h
    assert sum(times for _, times in plan) <= 1.01 * best_fit_decreasing(h) + 1
    assert sum(times * sum(a for _, a in f) for f, times in plan[:by_program]) > n / 2


def test_plan_does_not_hang_on_the_number_of_pieces():
    h = {k: 10**9 + k for k in range(513, 1025)}
    plan, by_program = packing.plan_sequences(h, 1024)
    assert sum(times for _, times in plan) == sum(h.values()) and by_program == len(plan) == 512
    h = {k: 10**9 for k in range(1, 1025)}
    plan, by_program = packing.plan_sequences(h, 1024)
    assert sum(times for _, times in plan) <= 1.0001 * sum(k * v for k, v in h.items()) / 1024
    assert packing.plan_sequences({}, 1024) == ([], 0)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_most_pieces_come_from_the_program(spark, sf):
    """Of all short pieces of the sample tables at least nine in ten; one sequence above the bound of total length, or two."""
    import os

    if not os.path.exists(f"/root/testdata/{sf}/documents.parquet"):
        pytest.skip("no sample tables")
    pieces = packing.token_pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), PATH, "doc_id", "text", 1024, 2)
    h = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan, by_program = packing.plan_sequences(h, 1024)
    short = sum(v for k, v in h.items() if k < 1024)
    placed = sum(times * sum(a for x, a in f if x < 1024) for f, times in plan[:by_program])
    assert placed >= 0.9 * short
    assert sum(times for _, times in plan) <= math.ceil(sum(k * v for k, v in h.items()) / 1024) + 2


def brute_groups(rows, threshold=85):
    sets = []
    for r in rows:
        w = WORD.findall((r.text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i].doc_id)
    least = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return sorted((str(rows[i].doc_id), len(sets[i]), str(least[find(i)])) for i in range(len(rows)))


def test_near_dedup_equals_brute_force(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_dedup.near_groups(docs).collect())
    assert got == brute_groups(rows)
    assert near_dedup.near_groups(empty).count() == 0
    assert near_dedup.without_near_duplicates(docs).columns == docs.columns


def test_chain_of_near_copies(spark):
    """Neighbours are linked, ends are not: one component through the links."""
    w = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join([f"u{j}" for j in range(2 * i)] + w[2 * i :])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_groups(df).collect()} == {0}


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 96).astype(np.uint64)
    sets = [np.unique(np.r_[base[d:], rng.integers(0, 2**62, d).astype(np.uint64)]) for d in (0, 3, 8, 16, 60)] + [base[:0]]
    p = near_dedup.parities(np.concatenate(sets), np.r_[0, np.cumsum([len(x) for x in sets])])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            differing = int(np.bitwise_count((p[i] ^ p[j]).view(np.uint64)).sum())
            apart = len(set(x) ^ set(y))
            assert differing <= apart and differing % 2 == apart % 2
            assert apart > 40 or differing >= 0.85 * apart


def test_superminhash_estimates():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.r_[a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)]
    values = np.r_[np.sort(a), np.sort(b)]
    s = near_dedup.signatures(values, np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15
    assert (near_dedup.signatures(values[:1], np.array([0, 1])) != near_dedup.FREE).all()


def test_pairs_whose_registers_agree_little_are_still_compared(spark, monkeypatch):
    """Only sizes and parities may rule a pair out: here half of all registers differ, and one band is shared."""
    real = near_dedup.signatures

    def spoiled(values, starts, m=near_dedup.REGISTERS):
        out = real(values, starts, m)
        out[:, m // 2 :] = near_dedup.mix(out[:, m // 2 :] + near_dedup.set_key(values, starts)[:, None])
        return out

    w = [f"v{i}" for i in range(400)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:390], *[f"u{i}" for i in range(10)]]))]
    monkeypatch.setattr(near_dedup, "signatures", spoiled)
    table = near_dedup.signature_table(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    a, b = table
    assert set(a.buckets) & set(b.buckets)
    monkeypatch.setattr(near_dedup, "signature_table", lambda docs, *args, **kw: spark.createDataFrame(table, _schema))
    _schema = "id long, text_hash long, n_shingles long, node long, buckets array<long>, " + ", ".join(f"{q} long" for q in a.__fields__[5:])
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}


@pytest.mark.parametrize("shared", [None, 7])
def test_different_texts_under_one_id(spark, shared):
    """Two texts under a null or an equal id, one of them a copy, or near one, of another document's."""
    w = [f"v{i}" for i in range(100)]
    copied, own, near, two = " ".join(w), " ".join(f"o{i}" for i in range(40)), " ".join([*w[:97], "x", "y", "z"]), " ".join(f"t{i}" for i in range(60))
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rest = lambda rows: sorted(r.text for r in near_dedup.without_near_duplicates(df(rows)).collect())
    assert rest([(1, copied), (shared, copied), (shared, own)]) == sorted([copied, own])
    got = rest([(shared, copied), (shared, near), (shared, two)])
    assert len(got) == 2 and two in got and (copied in got) != (near in got)
    lines = [(1, copied), (shared, f"{copied}\nstays"), (shared, f"{own}\nstays too")]
    out = sorted(r.text for r in line_dedup.without_duplicate_lines(df(lines)).collect())
    assert out == sorted([copied, "stays", f"{own}\nstays too"]) or (shared is None and out == sorted([f"{copied}\nstays", f"{own}\nstays too"]))


def test_edit_distance():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 25, 2))
        assert line_dedup.edit_distance(a, b, 100) == plain(a, b)
        assert line_dedup.edit_distance(a, b, 3) == min(plain(a, b), 4)


def test_line_dedup(spark, docs, empty):
    line = "The quarterly report describes measured performance across several regions and seasons"
    near = line.replace("measured", "measures")
    rows = [(1, f"{line}\nshort line"), (2, f"own words stay here\n{line.upper()}!"), (3, near), (4, "short line\n\nshort line"), (5, None), (6, ""), (7, f"{line}\n{line}\nkept")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "1 as line", "2 as node")
    got = {r.doc_id: r.text for r in line_dedup.without_duplicate_lines(df).collect()}
    assert got == {1: rows[0][1], 2: "own words stay here", 4: rows[3][1], 5: None, 6: "", 7: "kept"}
    assert line_dedup.without_duplicate_lines(docs).columns == docs.columns
    assert line_dedup.without_duplicate_lines(empty).count() == 0


def test_lines_with_several_typos_are_linked(spark):
    """Three changed words of eight, one word more, and one word split; words are short, so blocks stand for little text."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(4, 8))))
    rows = []
    for i in range(40):
        w = [word() for _ in range(8 + 4 * (i % 3))]
        few = w.copy()
        for k in rng.choice(8, 3, replace=False):
            few[k] = few[k][:1] + "z" + few[k][2:]
        split = w.copy()
        split[i % 8] = split[i % 8][:2] + " " + split[i % 8][2:]
        more = w[: i % 8] + ["of"] + w[i % 8 :]
        rows += [(4 * i + j, " ".join(x)) for j, x in enumerate((w, few, split, more))]
    got = {r.id: r.keeper_id for r in line_dedup.duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 4 for i in range(160) if i % 4}


@pytest.mark.parametrize("low, high, edits", [(8, 16, 1), (8, 16, 2), (8, 16, 3), (16, 32, 3), (32, 90, 3), (20, 90, -5)])
def test_recall_of_similar_lines_against_brute_force(low, high, edits):
    """Lines with letter edits (-5: in 5 % of the characters) that stay similar share a key: all with up to three edits, and nine in ten with more."""
    from latentia.llm.kernels import WordHasher

    rng = np.random.default_rng(17)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(n))) for n in rng.integers(1, 10, 3000)]  # many short words
    found = total = 0
    lines = []
    for _ in range(150):
        a = " ".join(rng.choice(vocabulary, int(rng.integers(low, high))).tolist())
        b = list(a)
        letters = [i for i, c in enumerate(b) if c != " "]
        for i in rng.choice(letters, edits if edits > 0 else max(1, len(a) * -edits // 100), replace=False):
            b[i] = "z" if b[i] != "z" else "y"
        if line_dedup.similar(a, "".join(b), 0.9):
            lines += [a, "".join(b)]
    raw, offsets, n, _, _ = line_dedup.normal_lines(["\n".join(lines)])
    h, _, starts = WordHasher(False).words(raw, offsets)
    chars = np.array([len(x) for x in lines])
    keys, rows = line_dedup.line_keys(h, starts, chars, 8, 0.9)
    held = collections.defaultdict(set)
    for k, r in zip(keys.tolist(), rows.tolist()):
        held[r].add(k)
    for i in range(0, len(lines), 2):
        total += 1
        found += bool(held[i] & held[i + 1])
    assert total > 30 and found >= (total if edits > 0 else 0.9 * total)


def test_classes_of_length_part_no_similar_lines():
    """Any two lengths of which the shorter has nine tenths of the longer share a class."""
    n = np.arange(1, 3000)
    line, group = line_dedup.length_classes(n, 0.9)
    held = collections.defaultdict(set)
    for i, g in zip(line.tolist(), group.tolist()):
        held[int(n[i])].add(g)
    for longer in range(1, 3000):
        shorter = longer - int(longer * (1 - 0.9) + 1e-9)
        assert all(held[x] & held[longer] for x in range(max(1, shorter), longer + 1))
    assert max(map(len, held.values())) <= 2


def test_normal_lines_equal_the_plain_rule():
    texts = ["Ärger über 12 Dinge!\n\n  -- \nNaïve_façade – it's 3.5%", None, "", "今日は良い天気です\nmixed 中文 words", "tab\tand\rreturn\x0bx", "ΑΒΓ δεζ\n١٢", "a\n"]
    raw, offsets, n, text, place = line_dedup.normal_lines(texts)
    got = [(t, p, k, raw[a:b].tobytes().decode()) for t, p, k, a, b in zip(text.tolist(), place.tolist(), n.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())]
    want = [(i, j, len(w), " ".join(w)) for i, t in enumerate(texts) if t for j, line in enumerate(t.split("\n")) if (w := line_dedup.normal(line))]
    assert got == want


def test_lines_without_spaces_are_linked(spark):
    line = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳"
    df = spark.createDataFrame([(1, line), (2, line[:10] + "大" + line[11:]), (3, line[::-1])], "doc_id long, text string")
    assert {r.id: r.keeper_id for r in line_dedup.duplicate_lines(df).collect()} == {2: 1}


def test_letter_parities_bound_the_edits():
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = ("".join(rng.choice(list("abé "), int(n))) for n in rng.integers(1, 40, 2))
        chars, bits = line_dedup.letter_parities([a, b])
        assert chars.tolist() == [len(a), len(b)]
        assert int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum()) <= 4 * line_dedup.edit_distance(a, b, 100)


def test_equal_short_lines(spark, tmp_path):
    """The query and the pipeline stage group equal lines of one word or more; lines without a word stay."""
    import corpus_pipeline

    rows = [(1, "And so on.\n\n--\nSIX words, they end right here"), (2, "six words they end right here!\nand so on\n--\n\nown"), (3, "own"), (4, "Own word\nnot own words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.removed_lines for r in line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 1], 3: [0], 4: []}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, df, "").collect()} == {1: rows[0][1], 2: "--\n\nown", 4: rows[3][1]}


def test_quality_statistics(docs, empty):
    rows = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    for r in quality.judge(rows.selectExpr("*", "null as lang", "null as source")).collect():
        w = WORD.findall(text[r.doc_id])
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        twice = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text[r.doc_id])), len(twice))
        assert r.base_failed == (len(w) < 20 or 100 * len(twice) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_quality_rejects_an_outlier(spark):
    rng = np.random.default_rng(8)
    rows = [(i, words(rng, int(rng.integers(40, 90))), "en", "s") for i in range(400)] + [(1000, "### $$$ &&& " * 5 + words(rng, 60).replace(" ", "### "), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000] and sum(got.values()) >= 396


def least_determinant(x, alpha):
    """The least determinant over all subsets of the nearest share's size."""
    import itertools

    h, factor = math.ceil(alpha * len(x) - 1e-9), quality.consistency(alpha, quality.P)
    best = min(itertools.combinations(range(len(x)), h), key=lambda k: np.linalg.slogdet(np.cov(x[list(k)].T, bias=True) * factor + np.diag(quality.FLOOR**2))[1])
    cov = np.cov(x[list(best)].T, bias=True) * factor + np.diag(quality.FLOOR**2)
    return x[list(best)].mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def test_estimates_are_those_of_least_determinant(spark):
    """Against all subsets of small groups: mostly the very subset, never far from its determinant."""
    rng = np.random.default_rng(5)
    groups = {f"g{i}": np.r_[rng.normal(0, 1, (9, 5)), rng.normal(6, 1, (3, 5))] for i in range(12)}
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{x} double" for x in quality.XS))
    same = 0
    for r in quality.fit_groups(df, 0.75).collect():
        centre, inverse, logdet = least_determinant(groups[r.g], 0.75)
        assert -np.linalg.slogdet(np.array(r.inverse).reshape(5, 5))[1] <= logdet + 0.5
        same += np.allclose(r.centre, centre) and np.allclose(np.array(r.inverse).reshape(5, 5), inverse)
    assert same >= 10


def test_cut_distance():
    """Known quantiles: F(0.95; 5, 10) = 3.3258, and chi-square with many rows."""
    h = 15  # 5 and 10 degrees
    assert quality.cut_distance(0.05, 5, h) == pytest.approx(5 * 14 / 10 * 3.32583 * (1 + 1 / 15), rel=1e-4)
    assert quality.cut_distance(1e-7, 5, 10**7) == pytest.approx(quality.chi2_quantile(1 - 1e-7, 5), rel=1e-3)


def test_quality_groups_and_fallbacks(spark):
    """Sources with enough rows go by their own estimate, however few; the others by their language, and a small language by all."""
    rng = np.random.default_rng(9)
    sizes = {("en", "a"): 12, ("en", "b"): 40, ("en", "c"): 3, ("de", None): 4, (None, "x"): 15}
    rows, i = [], 0
    for (lang, source), n in sizes.items():
        for _ in range(n):
            rows.append((i, words(rng, int(rng.integers(40, 90))), lang, source))
            i += 1
    rows.append((i, None, "en", "a"))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    by = {(rows[r.doc_id][2], rows[r.doc_id][3]): r.judged_by for r in got if r.doc_id < i}
    assert by == {("en", "a"): "group", ("en", "b"): "group", ("en", "c"): "lang", ("de", None): "all", (None, "x"): "group"}
    assert sum(r.kept for r in got) >= i - 1 and not next(r for r in got if r.doc_id == i).kept


def brute_winnow(grams, w=winnowing.W):
    """Places of the choices: in each window the least low 33 bits, the rightmost of equal ones."""
    low = [x & ((1 << 33) - 1) for x in grams]
    windows = [range(i, i + w) for i in range(len(low) - w + 1)] or ([range(len(low))] if low else [])
    return sorted({min(places, key=lambda i: (low[i], -i)) for places in windows})


def test_winnowing(spark, docs, empty):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b c d e f g a b c d e f g",), ("x x x x x x x x x",), ("one two",), ("",), (None,)], "text string")
    for r in winnowing.add_fingerprint(df, "text", "fp").select("text", "fp.pos").collect():
        n = len((r.text or "").split())
        assert len(r.pos) == len(set(r.pos)) and (bool(r.pos) == bool(n))
        if r.text and n >= 7:
            assert np.diff([-1, *sorted(r.pos)]).max() <= winnowing.W
    for r in winnowing.add_fingerprint(df, "text", "fp").select("fp").collect():
        assert [p.pos for p in r.fp] == sorted(p.pos for p in r.fp)
    tie = winnowing.add_fingerprint(df, "text", "fp").where(F.col("text").startswith("x x")).first()
    assert sorted(p.pos for p in tie.fp) == [3, 4, 5]  # the rightmost of equal ones in each window
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r.doc_id: r.text or "" for r in rows.collect()}
    order = sorted(text, reverse=True)
    import hashlib

    for r in winnowing.compare_with_edits(rows).collect():
        t, nxt = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert winnowing.compare_with_edits(docs).count() == docs.count() and winnowing.compare_with_edits(empty).count() == 0


def test_winnowing_against_brute_force_in_any_script(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abc"), 60).tolist()) for _ in range(10)] + ["".join(rng.choice(list("中文字学日本語"), 80).tolist()) for _ in range(10)] + ["Köln ist schön und groß wie eh und je", "ab中cd文 ef"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    hashed = winnowing.add_fingerprint(df, "text", "fp").withColumn("w", F.filter(F.split(winnowing.spaced(F.col("text")), winnowing.WHITE), lambda x: x != "")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    pair = lambda c, d: F.zip_with(F.slice(c, 1, F.size(c) - d), F.slice(c, d + 1, F.size(c) - d), lambda x, y: F.xxhash64(x, y))
    hashed = hashed.withColumn("g", pair("h", 1)).withColumn("g", pair("g", 2))
    for r in hashed.collect():
        assert r.w == re.findall(r"[一-鿿]|[^\s一-鿿]+", r.text)
        assert sorted((p.pos, p.hash) for p in r.fp) == [(i, r.g[i]) for i in brute_winnow(r.g)]


def test_winnowing_takes_ids_of_other_types(spark, docs):
    from pyspark.sql import functions as F

    number = F.coalesce(F.col("doc_id"), F.lit(-1))
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.col("id")).alias("text"))
    for rows in (docs, many):
        for kind in (F.format_string("%05d", number), F.date_add(F.lit("2020-01-01"), number.cast("int")), number.cast("double")):
            got = winnowing.compare_with_edits(rows.withColumn("doc_id", kind)).drop("doc_id").collect()
            want = winnowing.compare_with_edits(rows.withColumn("doc_id", number)).drop("doc_id").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_sainte_lague_equals_quotient_by_quotient():
    rng = np.random.default_rng(6)
    for _ in range(50):
        w, limits, seats = rng.integers(0, 50, 6).astype(float).tolist(), rng.integers(0, 30, 6).tolist(), int(rng.integers(0, 60))
        want = [0] * 6
        for _ in range(min(seats, sum(x for x, v in zip(limits, w) if v > 0))):
            q = [v / (2 * n + 1) if n < x and v > 0 else -1 for v, n, x in zip(w, want, limits)]
            want[int(np.argmax(q))] += 1
        got = mixing.sainte_lague(w, seats, limits)
        assert sum(got) == sum(want)
        quotient = lambda i, n: w[i] / (2 * n + 1)
        # the same seats but for quotients that are equal: no seat left out has a higher quotient than one given
        given = [quotient(i, got[i] - 1) for i in range(6) if got[i]]
        left = [quotient(i, got[i]) for i in range(6) if w[i] > 0 and got[i] < limits[i]]
        assert not given or not left or max(left) <= min(given) * (1 + 1e-12)
        assert len(set(w)) < 6 or sorted(given) == pytest.approx(sorted(quotient(i, want[i] - 1) for i in range(6) if want[i]))


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    by = collections.defaultdict(int)
    for r in rows:
        by[r.source_size, r.target] += r.taken
    assert all(abs(v - k[1]) <= 64 for k, v in by.items())
    assert mixing.mix(empty).count() == 0
    whole = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    taken = sum(r.taken for r in mixing.mix(whole).collect())
    out = mixing.mixed_documents(whole)
    assert out.columns == docs.columns and sum(len(WORD.findall(r.text)) for r in out.collect()) == taken
    for some in (docs, docs.union(docs), docs.selectExpr("cast(null as long) as doc_id", *docs.columns[1:])):  # repeated rows, and texts without an id
        taken = sum(r.taken for r in mixing.mix(some).collect())
        assert sum(len(WORD.findall(r.text)) for r in mixing.mixed_documents(some).collect()) == taken


def test_every_block_of_a_long_line_is_a_key():
    """A line of 400 words and one that has every third run of four words edited share all other runs."""
    from latentia.llm.kernels import WordHasher

    words = [f"word{i}x" for i in range(400)]
    raw, offsets, _, _, _ = line_dedup.normal_lines([" ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words)])
    h, _, starts = WordHasher(False).words(raw, offsets)
    assert len(set(line_dedup.block_keys(h, starts, 8)[0].tolist())) == 100


def test_distances_side_by_side_equal_those_one_by_one():
    rng = np.random.default_rng(3)
    letters = list("abcdefgh é漢")
    lines = []
    for n in [1, 9, 10, 11, 63, 64, 65, 310, 320, 700] * 30 + [1300] * 40:
        a = rng.choice(letters, n).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, n // 6 + 2))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.choice(letters, int(rng.integers(0, 2))).tolist()
        lines += ["".join(a), "".join(b)]
    test = line_dedup.similarity(0.9)
    held, i = test.gather(lines), np.arange(0, len(lines), 2)
    want = [line_dedup.similar(lines[k], lines[k + 1], 0.9) for k in i]
    assert test.many(held, i, i + 1).tolist() == want and 50 < sum(want) < len(want) - 50
    assert [test.exact(held, k, k + 1) for k in i] == want
    assert test.many(held, i[:3], i[:3] + 1).tolist() == [-1, -1, -1]  # too few to be worth it


def test_what_lines_begin_or_end_with_is_left_out_of_their_distance(monkeypatch):
    """Lines that share a long passage are compared on what is beside it, and on bands of half the width that edits would need on both sides."""
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    own = lambda n: "".join(rng.choice(list("ijklmnop "), n))
    lines = [x for k in range(60) for x in (own(20 + k) + passage, own(20 + (k * 7) % 60) + passage)]
    cells, banded = [], line_dedup.banded
    monkeypatch.setattr(line_dedup, "banded", lambda text, fa, la, fb, lb, most, width: (cells.append((int(la.max()), width)), banded(text, fa, la, fb, lb, most, width))[1])
    test = line_dedup.similarity(0.9)
    held, i = test.gather(lines), np.arange(0, len(lines), 2)
    want = [line_dedup.similar(lines[k], lines[k + 1], 0.9) for k in i]
    assert test.many(held, i, i + 1).tolist() == want and 5 < sum(want) < len(want) - 5
    assert cells and max(n for n, _ in cells) < 100 and {w for _, w in cells} == {1}


def test_candidates_are_dealt_out_by_pairs(spark, monkeypatch):
    """A few rows with many centres each are verified in many tasks."""
    from pyspark.sql import functions as F

    from latentia.llm import groups

    monkeypatch.setattr(groups, "GROUP_PAIRS", 100)
    rows = spark.range(40).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("a"), F.col("id").alias("comp"), F.sequence(F.lit(100).cast("long"), F.lit(149).cast("long")).alias("bs"))
    centres = spark.range(100, 150).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("b"), F.col("id").alias("comp_b"))
    data = spark.range(150).select(F.col("id").alias("node"), F.col("id").cast("string").alias("data"))
    seen = spark.sparkContext.accumulator(0)

    def gather(values):
        seen.add(1)
        return values

    test = groups.Test(gather, lambda held, i, js: js, lambda held, i, j: int(held[i]) + 100 == int(held[j]))
    found = {tuple(r) for r in groups.settle(rows, centres, data, test).collect()}
    assert found == {(i, i + 100) for i in range(40)}
    assert seen.value > 4


def test_members_from_packed_keys(spark, monkeypatch):
    """The same buckets as from a row for each key, also where a bucket is larger than what is held."""
    from pyspark.sql import functions as F

    from latentia.llm import groups

    rng = np.random.default_rng(5)
    keys = [[int(k) * 0x1234567890ABCD % (1 << 62) for k in rng.choice(400, 12)] + [7 << 40] for _ in range(300)]
    packed = [(n, bytearray(groups.key_bytes(np.array(k, np.uint64)).tobytes())) for n, k in enumerate(keys)]
    plain = spark.createDataFrame([(n, k) for n, k in enumerate(keys)], "node long, keys array<long>")
    for held in (groups.HELD_ROWS, 100):
        monkeypatch.setattr(groups, "HELD_ROWS", held)
        got = groups.shared_of_packed(spark.createDataFrame(packed, "node long, keys binary"))
        sets = lambda df: sorted(tuple(sorted(r.n)) for r in df.groupBy("bucket").agg(F.collect_list("node").alias("n")).collect())
        assert sets(got) == sets(groups.shared_members(plain.select(F.explode("keys").alias("bucket"), "node")))


def line_pairs(seed):
    """Lines of 3 to 2,000 characters of few different triples, each with a copy of some edits."""
    rng = np.random.default_rng(seed)
    lines = []
    for n in [3, 20, 125, 127, 128, 130, 380, 384, 390, 760, 770, 2000] * 8:
        a = rng.choice(list("aabc é"), n).tolist()
        b = list(a)
        for _ in range(int(rng.integers(0, n // 3 + 1))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.choice(list("abc "), int(rng.integers(0, 2))).tolist()
        lines += ["".join(a), "".join(b)]
    return lines


def test_keys_of_lines_are_never_written(spark, monkeypatch):
    """Keys go from the texts straight into their parts, whatever lies on disk meanwhile; lines are linked as before."""
    kept, keep = [], line_dedup.keep
    monkeypatch.setattr(line_dedup, "keep", lambda df: (kept.append(df.columns), keep(df))[1])
    words = [f"{a}{b}rd" for a in "bcdfg" for b in "aeiou"]
    line = " ".join(words)
    rows = [(1, f"{line}\n\nfew words"), (2, None), (3, line.replace("bard", "bart") + "\nfew words"), (4, "")]
    got = {r[0]: r[2] for r in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", exact_words=1).collect()}
    assert got == {3: [0, 1]}
    assert kept and not any("keys" in columns for columns in kept)


def test_triples_rule_out_no_similar_lines():
    """Sketches of different numbers of bins, also where bins are at their top, allow every similar pair and rule out unlike ones."""
    lines = line_pairs(3)
    chars, sketch = line_dedup.triple_sketches(lines)
    held, allow = (chars, line_dedup.bins_of(sketch)), line_dedup.triples_allow(0.9)
    i = np.arange(0, len(lines), 2)
    alike = np.array([line_dedup.similar(lines[k], lines[k + 1], 0.9) for k in i])
    assert allow(held, i, i + 1)[alike].all() and 20 < alike.sum() < len(i)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(3000)]
    other = [" ".join(rng.choice(words, 40)) for _ in range(200)]
    chars, sketch = line_dedup.triple_sketches(other)
    assert not allow((chars, line_dedup.bins_of(sketch)), np.arange(0, 200, 2), np.arange(1, 200, 2)).any()


def test_lines_of_a_common_phrase_leave_before_the_rounds(spark, monkeypatch):
    """Unlike lines with one phrase in one place are no members any more, similar ones stay together; so too where buckets are too large to be looked at."""
    from latentia.llm import groups

    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    rows = []
    for i in range(60):
        w = ["this", "is", "what", "they", *[word() for _ in range(20)]]
        rows.append((2 * i, " ".join(w)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join(w[:-1] + ["other"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = line_dedup.with_earlier
    monkeypatch.setattr(line_dedup, "with_earlier", lambda members, traits: seen.append(members.select("node").distinct().count()) or plain(members, traits))
    for most, left in ((groups.POSSIBLE_NODES, 12), (5, 66)):
        monkeypatch.setattr(groups, "POSSIBLE_NODES", most)
        got = {r.id: r.keeper_id for r in line_dedup.duplicate_lines(df).collect()}
        assert got == {20 * i + 1: 20 * i for i in range(6)} and seen.pop() == left


def test_buckets_are_cut_by_length():
    """Lengths of which one has nine tenths of the other are never further apart in steps, whatever their size."""
    from latentia.llm import groups

    n = np.arange(1, 6000)
    longest = np.array([x for x in range(1, 6000)])
    shortest = np.maximum(longest - np.floor(longest * (1 - 0.9) + 1e-9).astype(np.int64), 1)
    apart = groups.length_steps(n)[longest - 1].astype(int) - groups.length_steps(n)[shortest - 1]
    assert apart.max() <= groups.steps_apart(0.9) < 10
