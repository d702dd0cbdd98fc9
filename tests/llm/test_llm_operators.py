"""llm operators against plain versions of the same, and their edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandframe.llm import distinct, encoding, frequency, frequent, packing, spans, splitting


# ---- splitting ----


def plain_pieces(data: bytes, fastq: bool, limit: int, overlap: int):
    if len(data) <= limit:
        return []
    lines = data.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    records, cur = [], []
    for line in lines:
        if cur and ((fastq and len(cur) == 4) or (not fastq and line.startswith(b">"))):
            records.append(cur)
            cur = []
        cur.append(line)
    records.append(cur)
    units = []
    for r in records:
        if sum(map(len, r)) <= limit:
            units.append(sum(map(len, r)))
        else:
            for line in r:
                while len(line) > limit:
                    units.append(limit)
                    line = line[limit:]
                units.append(len(line))
    out, i = [], 0
    offs = np.r_[0, np.cumsum(units)].tolist()
    while True:
        j = i + 1
        while j < len(units) and offs[j + 1] - offs[i] <= limit:
            j += 1
        out.append((offs[i], offs[j]))
        if j == len(units):
            return out
        o = min(overlap, j - i - 1)
        while o and offs[j + 1] - offs[j - o] > limit:
            o -= 1
        i = j - o


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=">@A\n\r+", max_size=120), st.booleans(), st.integers(1, 30), st.integers(0, 5))
def test_pieces(text, fastq, limit, overlap):
    data = text.encode()
    assert splitting.pieces(data, "fastq" if fastq else "fasta", limit, overlap) == plain_pieces(data, fastq, limit, overlap)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="# \n-ab<>/éx1.", max_size=150), st.sampled_from(sorted(splitting.TREES)), st.integers(4, 40), st.integers(0, 3), st.booleans())
def test_pieces_of_any_tree(text, kind, limit, overlap, across):
    """Pieces are within the limit, cover the item in order, and never cut a character."""
    data, at = text.encode(), 0
    got = splitting.pieces(data, kind, limit, overlap, across)
    assert bool(got) == (len(data) > limit)
    for a, b in got:
        assert a <= at < b <= a + limit
        data[a:b].decode()
        at = b
    assert not got or at == len(data)


def cut(text, kind, limit, across=True):
    data = text.encode()
    return [data[a:b].decode(errors="replace") for a, b in splitting.pieces(data, kind, limit, 0, across)]


def test_trees():
    text = "# A\nx\n\ny\n# B\n## C\n- one\n- two\n  - 2b\n- three\n## D\nz\n# E\ne\n"
    assert cut(text, "text", 34) == ["# A\nx\n\ny\n# B\n", "## C\n- one\n- two\n  - 2b\n- three\n", "## D\nz\n# E\ne\n"]
    assert cut(text, "text", 34, across=False) == ["# A\nx\n\ny\n", "# B\n", "## C\n- one\n- two\n  - 2b\n- three\n", "## D\nz\n", "# E\ne\n"]
    page = "<div><p>one</p><p>two<br>three</p><ul><li>a</li><li>b</li></ul></div><p>end</p>"
    assert cut(page, "markup", 40) == ["<div><p>one</p><p>two<br>three</p>", "<ul><li>a</li><li>b</li></ul></div>", "<p>end</p>"]
    assert cut("é" * 10, "text", 7) == ["ééé"] * 3 + ["é"] and cut("日本", "text", 2) != []


def test_split_edges(spark):
    fa = ">a\nACGT\n>b\nACGTACGT\n"
    rows = [
        (1, "x.fa", None, None, 10, None, fa), (2, None, 100, -1, 10, 1, fa), (3, "x.fa", 50, 3, 2, 0, fa), (4, "x.fq", 0, 10**6, 0, 3, fa),
        (5, "x.fa", 0, None, 5, 0, None), (6, "x.fa", 0, None, 5, 0, ""), (1, "x.fa", None, None, 10, None, fa), (7, "x.fa", 0, 9, 4, -2, fa),
    ]
    df = spark.createDataFrame(rows, "i long, f string, s long, e long, m long, o int, b string").selectExpr("*", "1 as id", "2 as buffer", "3 as piece_start")
    out = splitting.split_items(df, "i", "f", "s", "e", "m", "o", "b")
    got = defaultdict(list)
    for r in out.collect():
        got[r[0]].append((r[1], r[2]))
    assert set(got) == {1, 2, 7}
    assert sorted(got[1]) == sorted([(0, 7), (8, 10), (11, 19)] * 2)
    assert got[2][0] == (100, 107)
    assert splitting.split_items(df.limit(0), "i", "f", "s", "e", "m", "o", "b").count() == 0


# ---- shared spans ----


def plain_spans(records, w):
    where = defaultdict(set)
    for rec, t in records:
        for p in range(len(t) - w + 1 if t else 0):
            where[t[p : p + w]].add(rec)
    out = set()
    covered = defaultdict(set)
    for rec, t in records:
        for p in range(len(t) - w + 1 if t else 0):
            if len(where[t[p : p + w]]) > 1:
                covered[rec] |= set(range(p, p + w))
    for rec, c in covered.items():
        for p in c:
            if p - 1 not in c:
                q = p
                while q in c:
                    q += 1
                out.add((rec, p, q - p))
    return out


def test_spans(spark):
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = [dna(200) for _ in range(6)]
    rows = []
    for i in range(150):
        s, a = rng.choice(shared), rng.randrange(0, 150)
        rows.append((i, dna(rng.randrange(0, 80)) + s[a : a + rng.randrange(36, 70)] + dna(rng.randrange(0, 80))))
    rows += [(900, "A" * 130), (901, "A" * 41), (902, "AAG" * 40), (903, "AG" * 60 + dna(9)), (904, "GA" * 45), (905, None), (906, ""), (907, "é日" * 30), (908, "é日" * 25), (909, "acgt" * 12)]
    rows += [rows[3], (900, "A" * 130)]
    df = spark.createDataFrame(rows, "rec long, text string").selectExpr("*", "1 as sign", "'x' as window").drop("sign", "window")
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == plain_spans(rows, 40)
    assert spans.shared_spans(df.limit(0)).count() == 0
    share = {r["rec"]: r for r in spans.shared_share(df).collect()}
    assert share[905]["n_chars"] == 0 and share[906]["share"] == 0.0 and share[901]["share"] == 1.0


@pytest.mark.parametrize(("block", "filtered"), [(64, 0), (1000, 1 << 20), (1 << 20, 1 << 20)])
def test_long_records(monkeypatch, spark, block, filtered):
    monkeypatch.setattr(spans, "BLOCK", block)
    monkeypatch.setattr(spans, "FILTERED", filtered)
    rng = random.Random(8)
    text = "".join(rng.choice("ACGT") for _ in range(spans.PART + 5000))
    at = spans.PART - 700
    df = spark.createDataFrame([(1, text), (2, "C" + text[at : at + 2900]), (3, text[:39])], "rec long, text string")
    first = at if text[at - 1] != "C" else at - 1
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == {(1, first, 2900 + at - first), (2, 1 - (at - first), 2900 + at - first)}
    same = [(1, "A" * 3000), (2, "C" * 50 + "A" * 700 + "G"), (3, "AT" * 400)]
    df = spark.createDataFrame(same, "rec long, text string")
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == plain_spans(same, 40)


# ---- distinct ----


def test_distinct_error(spark):
    df = spark.range(60000).selectExpr("id % 3 as g", "cast(id % 20000 as string) as v", "cast(id % 7 as string) as h")
    exact = {(None, None, None): 0}
    for own in (["g"], ["h"], ["g", "h"]):
        for r in df.selectExpr("v", *[x if x in own else f"null as {x}" for x in ("g", "h")]).distinct().groupBy("g", "h").count().collect():
            exact["+".join(own), r["g"], r["h"]] = r["count"]
    for r in distinct.distinct_by_all(df, ["g", "h"], "v").collect():
        n = exact[r["level"], r["g"], r["h"]]
        assert abs(r["distinct"] - n) < 4 * r["std_error"] * n
    small = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "x"), ("b", None)], "g string, v string")
    assert {(r["g"], r["distinct"]) for r in distinct.distinct_by_all(small, ["g"], "v").collect()} == {("a", 2), (None, 1)}
    assert distinct.distinct_by_all(small.limit(0), ["g"], "v").count() == 0


def test_distinct_precision(spark):
    df = spark.range(3000).selectExpr("1 as g", "cast(id as string) as v")
    with pytest.raises(ValueError, match="precision"):
        distinct.registers(df, ["g"], "v", 10)
    row = distinct.estimate(distinct.registers(df, ["g"], "v", 8), ["g"], 8).first()
    assert abs(row["distinct"] - 3000) < 4 * row["std_error"] * 3000 and row["std_error"] == 1.04 / 16


def test_distinct_merge(spark):
    df = spark.range(5000).selectExpr("1 as g", "cast(id as string) as v")
    parts = [distinct.registers(df.where(f"pmod(hash(v), 2) = {i}"), ["g"], "v") for i in (0, 1)]
    assert distinct.estimate(distinct.merge(*parts, ["g"]), ["g"]).collect() == distinct.estimate(distinct.registers(df, ["g"], "v"), ["g"]).collect()


# ---- frequent and frequency ----


def observations(n=20000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = f"k{int(rng.paretovariate(0.6)) % 3000}"
        rows.append((i, i // 25, 1 if rng.random() < 0.8 else None, v))
    return rows + rows[:500] + [(10**6, 1, 1, None)]


def test_sketch_bounds():
    rng = np.random.default_rng(0)
    values = rng.zipf(1.3, 50000) % 5000
    s = frequent.Sketch(16, 2, 64)
    true = Counter()
    for part in np.array_split(values, 20):
        h, n = np.unique(part, return_counts=True)
        mixed = (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        s.add(mixed, n, h.astype(object))
        true.update(dict(zip(h.tolist(), n.tolist())))
    assert s.votes.sum() + s.light.sum() == len(values)
    for h, v, name in zip(s.hash.ravel(), s.votes.ravel(), s.names.ravel()):
        if v:
            assert v <= true[name] <= v + s.light[s.cell(np.array([h]))[0]]


@pytest.mark.parametrize("size", [(frequent.BUCKETS, frequent.SLOTS, frequent.LIGHT), (4, 1, 8)])
def test_most_frequent(spark, monkeypatch, size):
    for name, x in zip(("BUCKETS", "SLOTS", "LIGHT"), size, strict=True):
        monkeypatch.setattr(frequent, name, x)
    monkeypatch.setattr(frequent.Sketch.__init__, "__defaults__", size)
    rows = observations()
    true = defaultdict(Counter)
    for i, _, g, v in {r for r in rows if r[3]}:
        true[g][v] += 1
    df = spark.createDataFrame(rows, "id long, record long, grp int, value string").selectExpr("*", "1 as n", "2 as votes", "3 as cell", "4 as no", "5 as g", "6 as v")
    got = defaultdict(dict)
    for r in frequent.most_frequent(df, 5, "id").collect():
        got[r["grp"]][r["value"]] = r["n"]
    for g, c in true.items():
        assert got[g] == dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5])
    assert frequent.most_frequent(df.limit(0), 5, "id").count() == 0


def test_most_frequent_of_a_flat_column(spark):
    """No value stands out, and ties are settled by value."""
    df = spark.range(30000).selectExpr("id", "cast(id % 2 as int) as grp", "concat('v', lpad(cast(id % 15000 as string), 5, '0')) as value")
    got = sorted((r["grp"], r["value"], r["n"]) for r in frequent.most_frequent(df, 3, "id").collect())
    assert got == [(g, f"v{2 * i + g:05d}", 2) for g in (0, 1) for i in range(3)]


def test_frequencies(spark):
    rows = observations(seed=2)
    n, records = Counter(), defaultdict(set)
    for i, rec, _, v in {r for r in rows if r[3]}:
        n[v] += 1
        records[v].add(rec)
    df = spark.createDataFrame(rows, "id long, record long, grp int, value string")
    for sample in (df, df.where("value = 'k1'"), df.limit(0)):  # whatever the sample finds, counts are the same
        got = {r["value"]: (r["n"], r["records"]) for r in frequency.frequencies(df, sample, 20000).collect()}
        assert got.pop(None) == (1, 1)
        assert got == {v: (n[v], len(records[v])) for v in n}
    assert frequency.frequencies(df.limit(0), df.limit(0), 0).count() == 0


# ---- encoding ----


def reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=encoding.vocabulary().ids, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.text(alphabet="ab \n\t'slétr01=-日", max_size=80))
def test_encode(a, b):
    text = a + b + "<|endoftext|>"
    assert list(encoding.encoder("byte_bpe_50k", encoding.TOKENIZERS).encode(text)) == reference_encoder().encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=20))
def test_prefix_table(a, b):
    ref, t = reference_encoder(), encoding.PrefixTable(encoding.vocabulary(), a)
    t.append(b)
    whole = a + b
    for size in range(len(whole) + 1):
        ids = t.tokens(size)
        assert b"".join(t.vocab.text[i] for i in ids) == whole[:size]
        assert ids == (ref._encode_single_piece(whole[:size]) if size else [])
    t.truncate(len(a))
    assert t.tokens() == encoding.PrefixTable(t.vocab, a).tokens()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r.é", max_size=60), st.integers(0, 60), st.integers(0, 20), st.text(alphabet="ab \n.", max_size=20))
def test_edited_text(text, start, size, new):
    e = encoding.encoder("byte_bpe_50k", encoding.TOKENIZERS)
    t = encoding.EncodedText(e, text)
    start = min(start, len(text))
    end = min(start + size, len(text))
    t.replace(start, end, new)
    t.append(new)
    want = text[:start] + new + text[end:] + new
    assert t.text == want and t.ids() == list(e.encode(want))


def test_encode_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (3, "  \n"), (None, "x" * 200000), (5, "a\r\nb")], "doc_id long, text string").selectExpr("*", "'q' as id", "1 as ids")
    got = [(r["doc_id"], r["ids"]) for r in encoding.encode_column(df, "doc_id", "text").collect()]
    assert len(got) == 6 and (1, []) in got and (2, []) in got
    assert len(dict(got)[None]) == len(reference_encoder().encode_ordinary("x" * 200000))
    assert encoding.encode_column(df.limit(0), "doc_id", "text").count() == 0


# ---- packing ----


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan(sizes):
    counts = np.bincount(sizes, minlength=41) if sizes else np.zeros(41, int)
    used, n = Counter(), 0
    for pattern, m in packing.plan(counts, 40):
        assert sum(pattern) <= 40 and m > 0
        n += m
        for x in pattern:
            used[x] += m
    assert used == Counter(sizes)
    bins = []  # plain best fit decreasing is the measure
    for x in sorted(sizes, reverse=True):
        fit = [b for b in bins if b[0] >= x]
        if fit:
            min(fit, key=lambda b: b[0])[0] -= x
        else:
            bins.append([40 - x])
    assert n <= len(bins)


@pytest.mark.parametrize("draw", [lambda r: r.integers(1, 2049, 50000), lambda r: np.clip(r.lognormal(6.5, 1, 50000).astype(int), 1, 2048), lambda r: r.integers(500, 1100, 50000)])
def test_fill(draw):
    """As full as best fit decreasing, item by item."""
    sizes = draw(np.random.default_rng(5))
    gaps, n = np.zeros(2049, np.int64), 0
    for x in np.sort(sizes)[::-1]:
        fit = gaps[x:].nonzero()[0]
        gap = int(fit[0]) + x if len(fit) else 2048
        n += not len(fit)
        gaps[gap] -= bool(len(fit))
        gaps[gap - x] += 1
    assert sum(m for _, m in packing.plan(np.bincount(sizes, minlength=2049), 2048)) <= n


def test_pack(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([0, 1, 5, 17, 17, 17, 20, 40, 41, 95, None])) for i in range(3000)] + [(7, 17), (7, 17), (None, 3)]
    df = spark.createDataFrame(rows, "id long, n long").selectExpr("*", "1 as size", "2 as piece", "3 as start")
    got = packing.pack(df, "id", "n", 40).collect()
    fill, tokens = Counter(), Counter()
    for r in got:
        fill[r["container_id"]] += r["size"]
        tokens[r["id"]] += r["size"]
    want = Counter()
    for i, n in rows:
        want[i] += n or 0
    assert max(fill.values()) <= 40 and tokens == want
    assert len(got) == sum(max(1, -(-(n or 0) // 40)) for _, n in rows)
    assert sum(fill.values()) / 40 / len(fill) > 0.97
    assert packing.pack(df.limit(0), "id", "n", 40).count() == 0
    assert {r["container_id"] for r in packing.pack(spark.createDataFrame([(1, 0)], "id long, n long"), "id", "n", 40).collect()} == {0}
