"""Operators against brute force, and their edge cases."""

import collections
import hashlib
import random
import re
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, decontaminate, jaccard, licenses, mixing, oracles, quality, substring, tokens, toxicity, urls, warc
from quillon.llm.common import shared_path, stage
from quillon.llm.queries import queries, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, f string, h string, size string, n string, kept_id string, m string, tag string"


def random_docs(n=60, seed=1):
    """Texts of few words with shared passages, copies and near copies."""
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "and", "Été", "x%%", "alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 60))
    passages = [[word() for _ in range(r.randint(14, 40))] for _ in range(4)]
    out = []
    for i in range(n):
        if i > 5 and r.random() < 0.3:
            words = out[r.randrange(len(out))][1].split(" ")
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(r.randint(1, 120))]
            if r.random() < 0.5:
                at = r.randint(0, len(words))
                words[at:at] = r.choice(passages)
        out.append((i, " ".join(words)))
    return out


EDGES = [
    (None, "a text without an id that is long enough to have five words"), (None, "a text without an id that is long enough to have five words"),
    (1000, None), (1001, ""), (1002, " \t\n\x0b "), (1003, "word"), (1004, "one two three four five six seven"), (1004, "one two three four five six seven"),
    (1004, "the same id under another text"), (1005, " ".join(f"w{i % 977}" for i in range(30_000))), (1006, "tab\tseparated\nlines\r\nand \x0bmore"), (1007, "\u00a0 nbsp \u2003 em\u2029 ctrl\x1c x"),
]


def table(spark, rows):
    """A documents table with further columns whose names operators use inside."""
    r = [(d, t, "en", None if (d or 0) % 7 == 3 else f"src{(d or 0) % 4}", len(t or ""), *(["x"] * 8)) for d, t in rows]
    return spark.createDataFrame(r, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return random_docs() + EDGES


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stage(table(spark, rows), "test")


@pytest.fixture(scope="module")
def empty(spark):
    return stage(table(spark, []), "test")


# --- spans that repeat -------------------------------------------------------------------------------------------------


def brute_spans(rows, length):
    first = {}
    split = [(np.inf if d is None else d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            first[g] = min(first.get(g, np.inf), d)
    out = []
    for (d, w), (raw, _) in zip(split, rows, strict=True):
        gone = {i + k for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < d for k in range(length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((raw, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("length", [3, 13])
def test_repeated_spans(docs, rows, length):
    got = [tuple(r) for r in substring.digests(docs, length=length).collect()]
    assert collections.Counter(got) == collections.Counter(brute_spans(rows, length))


def test_runs_pack(spark):
    r = substring.merged(np.array([[5, 0, 3, 1, 1, 0, 7], [5, 0, 2, 1, 1, 0, 6], [5, 0, 4, 1, 2, 0, 8], [4, 0, 9, 1, 1, 0, 0]]))
    assert r.tolist() == [[4, 0, 9, 1, 1, 0, 0], [5, 0, 2, 2, 1, 0, 6], [5, 0, 4, 1, 2, 0, 8]]
    assert (substring.unpack_runs(substring.pack_runs(r)) == r).all()


def test_automaton_finds_the_smallest_document():
    r = random.Random(3)
    for _ in range(60):
        texts = [(d, [bytes([97 + r.randrange(3)]) for _ in range(r.randint(1, 25))]) for d in r.sample(range(50), 6)]
        automaton = substring.Automaton()
        for d, w in texts:
            automaton.add(w, d)
        automaton.finish()
        for length in (1, 2, 4):
            query = [bytes([97 + r.randrange(4)]) for _ in range(40)]
            want = []
            for i in range(len(query) - length + 1):
                g = query[i : i + length]
                want.append(min((d for d, w in texts if any(w[k : k + length] == g for k in range(len(w) - length + 1))), default=substring.NULL_ID))
            assert list(automaton.found(query, length)) == want


def test_only_smaller_documents_are_reported():
    import pyarrow as pa

    words = b" ".join(b"w%d" % i for i in range(20))

    def report(*x):
        n = len(x)
        batch = pa.RecordBatch.from_pydict({"shard": [1] * n, "copy": [0] * n, "query": [q for q, _, _ in x], "doc_id": [d for _, d, _ in x], "tag": [0] * n, "start": [100] * n, "words": [w for _, _, w in x]})
        return [substring._windows([h]).tolist() for b in substring._report(13)(iter([batch])) for h in b.column("hits").to_pylist()]

    assert report((False, 3, words), (True, 4, words)) == [list(range(100, 108))]
    assert report((False, 3, words), (True, 3, words)) == [] and report((False, 3, words), (True, 9, words + b" new")) == [list(range(100, 108))]
    assert report((False, 3, words), (True, 9, b"new " + words)) == [list(range(101, 109))]
    assert report((False, 3, words), (True, None, words[:-4])) == [list(range(100, 107))]


def test_windows_with_equal_hashes(spark):
    """With window hashes of 12 bits most windows meet others that hide their owners; they go round again until all are settled."""
    rows = random_docs(40, 5) + EDGES[:9] + EDGES[10:]
    docs = stage(table(spark, rows), "test")
    got = [tuple(r) for r in substring.deduplicate(docs, text_out=False, bits=12).collect()]
    assert collections.Counter(got) == collections.Counter(brute_spans(rows, 13))


# --- near duplicates ---------------------------------------------------------------------------------------------------


def brute_jaccard(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = lambda ids: min((d for d in ids if d is not None), default=None)
    groups, classes = collections.defaultdict(list), collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
        classes[frozenset(sets[i])].append(d)
    return [(d, low(groups[find(i)]) if sets[i] else d, links[i], low(classes[frozenset(sets[i])]) if sets[i] else d, len(sets[i])) for i, (d, _) in enumerate(rows)]


def test_near_duplicates(docs, rows):
    got = collections.Counter(tuple(r) for r in jaccard.join(docs).collect())
    assert got == collections.Counter(brute_jaccard(rows))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {r[0] for r in brute_jaccard(rows) if r[0] == r[1]} == set(ids)


def test_near_duplicates_without_ids(spark):
    """Rows that lack or share an id are linked as others are, and one row of each class is kept."""
    words = [f"v{i}" for i in range(100)]
    near = lambda k: " ".join([*words[:-1], f"end{k}"])
    lone, other = " ".join(f"z{i}" for i in range(20)), " ".join(f"y{i}" for i in range(20))
    rows = [(None, near(0)), (None, near(0)), (None, near(1)), (3, near(2)), (None, lone), (None, lone), (7, other), (7, near(3)), (8, other), (None, ""), (None, None)]
    docs = stage(table(spark, rows), "test")
    assert collections.Counter(tuple(r) for r in jaccard.join(docs).collect()) == collections.Counter(brute_jaccard(rows))
    kept = collections.Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect())
    assert kept == collections.Counter([(3, near(2)), (None, lone), (7, other), (None, ""), (None, None)])


def test_large_buckets_are_split_and_dealt_in_blocks(spark, monkeypatch):
    """With small limits, groups go through splits and pairs of blocks and still lose nothing."""
    r = random.Random(5)
    base = [f"w{r.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(40):
        words = list(base)
        words[r.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*base[:30], *(f"u{r.randint(0, 9999)}" for _ in range(100))])) for i in range(20)]
    monkeypatch.setattr(jaccard, "LIMIT", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    got = {tuple(x) for x in jaccard.join(table(spark, rows)).collect()}
    assert got == set(brute_jaccard(rows))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[400] == got[500] == 400


def test_runs_for_recall():
    assert jaccard.n_runs(0.8, 0.9999) > jaccard.n_runs(0.8, 0.99) > 1


# --- decontamination ---------------------------------------------------------------------------------------------------


def edit_distance_inside(item, text):
    """The least number of word edits that turn the item into a part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    r = random.Random(2)
    for _ in range(300):
        item, text = ([r.randint(1, 4) for _ in range(r.randint(1, n))] for n in (70, 90))
        masks = {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontaminate.myers(masks, len(item), text, len(item))[0] == edit_distance_inside(item, text)


def test_contamination(spark, docs, rows):
    items = [(1, "Alpha beta; gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, "..."), (4, "One two three four five six SEVEN"), (5, rows[3][1]), (5, rows[3][1])]
    r = random.Random(0)
    more = []
    for i in range(30):
        words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
        for _ in range(i % 5):
            k = r.randrange(len(words))
            words[k : k + 1] = r.choice([[], ["new"], [words[k], "new"]])
        more.append((2000 + i, "before " * r.randint(0, 9) + " ".join(words) + " after" * r.randint(0, 9)))
    data = table(spark, rows + more)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(data, bench, least_words=1).collect()}
    want = {}
    fold = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    for d, t in rows + more:
        for item, x in items:
            w = fold(x)
            if w and (e := edit_distance_inside(w, fold(t))) <= int(len(w) * decontaminate.RATE):
                want[d, item] = min(e, want.get((d, item), 99))
    assert set(got) == set(want)
    clean = decontaminate.clean(data, bench, least_words=1)
    assert clean.columns == data.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows + more} - {d for d, _ in want} | {1004}  # another text of that id is clean
    dealt = decontaminate.blocks(bench, block=1)  # more blocks than a process keeps
    assert len(dealt.names) > decontaminate.KEPT
    assert {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(data, bench, block=1, least_words=1).collect()} == got


def test_short_items_and_items_without_id(spark):
    data = spark.createDataFrame([(1, "yes we can see it"), (2, "one two three four five six"), (3, None), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Yes"), (2, "we can see it"), (None, "two three four five six"), (4, None), (5, " .,")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(data, bench).collect()] == [(2, None, 0, 1, 6)]
    assert {r.doc_id for r in decontaminate.clean(data, bench).collect()} == {1, 3, 4}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(data, bench, least_words=1).collect()} == {(1, 1), (1, 2), (2, None)}


# --- licenses ----------------------------------------------------------------------------------------------------------


def test_license_spans(spark):
    texts = [
        "Released under the MIT License. Released under the MIT License", "Licensed under the Apache License, Version 2.0", "x CC BY-NC 4.0 y", "licensed under the GNU Genral Public Licence", "All Rights Reserved.",
        "under the mit licens", "nothing here", None, "UNDER THE MIT LICENSÉ",
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 1, 6, "mit")
    assert got[1].base_labels == "apache-2" and got[1].n_base == 1 and got[1].first_word == 3
    assert got[2].base_labels == "cc-by-nc" and got[2].n_words == 7
    assert got[3].labels == "gpl" and got[3].spans[0].edits == 2 and 0.9 < got[3].score < 1
    assert got[4].labels == "proprietary" and got[5].base_labels == "" and got[6].labels == "" and got[7].n_words == 0 and got[7].first_word is None
    assert got[8].n_base == 0


def test_license_base_counts(docs, rows):
    got = collections.Counter((r.doc_id, r.n_words, r.n_base) for r in licenses.scan(docs, base={"the1 of2": "x", "the3": "y", "x": "z"}).collect())
    want = collections.Counter()
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want[d, len(w), sum(w[i : i + len(p)] == p for p in (["the1", "of2"], ["the3"], ["x"]) for i in range(len(w)))] += 1
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_pigeonhole_loses_no_match(seed):
    import regex

    r = random.Random(seed)
    scanner = licenses.Scanner([("a", "released under the green tree license of peace")], 12)
    text, e = scanner.notices[0][1:]
    for _ in range(100):
        s = list(text)
        for _ in range(r.randint(0, e)):
            k = r.randrange(len(s))
            s[k : k + 1] = r.choice([[], ["q"], [s[k], "q"]])
        joined = "zz " * r.randint(0, 5) + "".join(s) + " yy" * r.randint(0, 5)
        assert regex.search(f"(?:{text}){{e<={e}}}", joined) and scanner.search(joined)


# --- tokens ------------------------------------------------------------------------------------------------------------


def test_shards_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    shards = tokens.write(docs, path, shared_path(spark, "t"))
    got = [tuple(r) for r in tokens.read(shards).orderBy("start").collect()]
    plain = Tokenizer.from_file(path)
    ids = {t: plain.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    assert sorted((-1 if g[0] is None else g[0]) for g in got) == [-1 if g[0] is None else g[0] for g in got]
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)]).tolist()[:-1]
    want = collections.Counter((d, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t in rows)
    assert collections.Counter((g[0], g[2], g[3]) for g in got) == want
    from quillon.llm import files

    for row in shards.collect():
        with files.opened(row.uri) as f:
            shard = tokens.Shard(f)
            assert shard.get(-12345) is None and shard.get(10**15) is None
            for key in set(shard.keys[~shard.null].tolist()):
                assert shard.get(key).tolist() in [ids[t] for d, t in rows if d == key]


def test_keyed_access(spark, docs, rows):
    """Keys are routed to their shards and looked up there, each by a few reads of a few bytes; those that no shard has are not found."""
    from tokenizers import Tokenizer

    from quillon.llm import files

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    shards = tokens.write(docs, path, shared_path(spark, "t"))
    wanted = [d for d, _ in rows if d is not None and d % 3 == 0] + [1005, 5000, -1]
    got = {r.doc_id: r.ids for r in tokens.fetch(shards, spark.createDataFrame([(d,) for d in [*wanted, None]], "doc_id long")).collect()}
    assert set(got) == {d for d in wanted if d in {x for x, _ in rows}}
    for d, ids in got.items():
        assert ids in [plain.encode(t or "", add_special_tokens=False).ids + [2] for x, t in rows if x == d]

    class Counted:
        def __init__(self, file):
            self.file, self.reads = file, []

        def size(self):
            return self.file.size()

        def read_at(self, size, at):
            self.reads.append(size)
            return self.file.read_at(size, at)

    row = next(r for r in shards.collect() if r.first_id is not None)
    with files.opened(row.uri) as f:
        counted = Counted(f)
        shard = tokens.Shard(counted)
        assert shard.get(row.first_id) is not None and len(counted.reads) <= 7 and sum(counted.reads[1:6]) <= 40
    lone = tokens.Writer(__import__("io").BytesIO(), np.dtype("<u2"))
    lone.add(None, b"\x01\x00")
    lone.close()


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """Words are cut only where the tokenizer's own settings allow it; all others give the library's ids of whole texts."""
    import json

    from tokenizers import Tokenizer

    assert tokens.cuts_words(tokenizer_path()) and not tokens.cuts_words(tokenizer_path("byte_bpe_50k.json"))
    settings = json.load(open(tokenizer_path(), encoding="utf-8"))
    settings["normalizer"]["normalizers"].pop()  # no lower case
    (tmp_path / "t.json").write_text(json.dumps(settings), encoding="utf-8")
    texts = ["Some  Text, WITH spaces.\nAnd lines", None, "", "don't  stop"]
    for path in (str(tmp_path / "t.json"), tokenizer_path("byte_bpe_50k.json")):
        plain, own = Tokenizer.from_file(path), tokens.encoder(path)
        assert not own.by_word and [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_words_are_tokens_of_their_own():
    from tokenizers import Tokenizer

    plain, own, r = Tokenizer.from_file(tokenizer_path()), tokens.encoder(tokenizer_path()), random.Random(1)
    letters = "aAzZéÉßñ ,.!?'\n\t\r\x0b\x0c\x1c\x1d\x85\xa0 ́İΣσς015٣<|endoftext|>-_.,,.  'S'T​𝔸中"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>", "<|ENDOFTEXT|>a,", "it's, we'll. I'M."]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 4001])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    pilots, slots = tokens.build_index(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    if n:
        assert (tokens.find_slots(keys, pilots, len(keys))[0] == slots).all()


# --- archives ----------------------------------------------------------------------------------------------------------


def test_archives(spark):
    big = "<p>" + "é" * 900
    rows = [(1, "http://a/", big), (5, "http://b/\n x", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", "y" * 1000), (5, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("keeper", F.lit(2))
    packages = warc.write(pages, shared_path(spark, "w"))
    got = collections.Counter(tuple(r) for r in warc.read(packages).collect())
    want = collections.Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        keep = max((q or -1) for q, _, x in rows if (x or "") == (h or ""))
        other = len(data) >= 1000 and p != keep
        want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", keep if other else None] += 1
    assert got == want
    assert warc.read(warc.write(pages.limit(0), shared_path(spark, "w"))).count() == 0


def test_zip64_directories(tmp_path, monkeypatch):
    """Archives with ZIP64 fields, forced by small limits, and with a comment and a large local extra field."""
    from pyarrow import fs

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(5):
            with z.open(f"m{i}.bin", "w", force_zip64=True) as f:
                f.write(bytes([i]) * 150)
        z.comment = b"a comment"
    file = fs.LocalFileSystem().open_input_file(str(path))
    found = warc.members(file)
    assert len(found) == 5
    for i in range(5):
        m = found[f"m{i}.bin"]
        assert m.size == 150 and file.read_at(m.size, warc.data_start(file, m)) == bytes([i]) * 150
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y")
    file = fs.LocalFileSystem().open_input_file(str(path))
    with pytest.raises(ValueError, match="compressed"):
        warc.data_start(file, warc.members(file)["x"])
    path.write_bytes(b"no archive")
    with pytest.raises(ValueError, match="ZIP"):
        warc.members(fs.LocalFileSystem().open_input_file(str(path)))


# --- mixing ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, target, free, left = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in free}
        for s in full:
            target[s] = cap * sizes[s]
            free.remove(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(d for d, _ in rows)
    of = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for d, t in rows:
        sizes[of[d]] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    for r in got:
        taken[of[r.doc_id]] += r.taken
        assert r.target == pytest.approx(want[of[r.doc_id]]) and r.source_size == sizes[of[r.doc_id]] and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    largest = {s: max(len(WORD.findall(t or "")) for d, t in rows if of[d] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.apply(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +collections.Counter({d: sum(r.copies for r in got if r.doc_id == d) for d, _ in rows})


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 5, 100, 10_000]) for i in range(r.randint(1, 12))} | {None: 7}
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    ranged = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), range_sources=3).collect()}
    assert ranged == got
    assert all(got[s] == pytest.approx(want[s]) for s in sizes) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_rows_without_ids_meet_their_targets(spark):
    """Rows that lack or share an id are taken one by one, so sources come near their targets all the same."""
    r = random.Random(2)
    rows = [(r.choice([None, 7]), " ".join(f"w{r.randrange(99)}" for _ in range(r.randint(1, 30))), s) for s in "abcd" for _ in range(r.randint(50, 200))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for size, target in {(x.source_size, x.target) for x in got}:
        assert abs(sum(x.taken for x in got if (x.source_size, x.target) == (size, target)) - target) <= 16


# --- quality -----------------------------------------------------------------------------------------------------------


def test_quality_counts(spark, docs, rows):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.counts(docs).collect())
    more = [(1, "a b c d e f g h\n\n a b c d e f g h\n|x|\n|x|"), (2, "z " * 40)]
    got += collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.counts(table(spark, more)).collect())
    want = collections.Counter()
    for d, t in rows + more:
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want[d, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)] += 1
    assert got == want


def test_quality_finds_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = quality.judge(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    good, bad = n.get((1, True), 0), n.get((0, False), 0)
    assert bad >= 0.9 * (bad + n.get((0, True), 0)) and good >= 0.9 * (good + n.get((1, False), 0))


# --- urls --------------------------------------------------------------------------------------------------------------


def test_rules_and_hosts(spark):
    urls_ = ["http://A.B.example.COM/en/7x?q#f", "https://example.com/en/1", "x://com/en/", "com/en/", None, "http://notcom/en/x", "http://a.net/de/8", "http://example.net/de/81", "http://x.org?/es/", "a://b://c/d", "http://h"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls_)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[0] == ("a.b.example.com", "/en/7x", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None) and got[5][2] is None
    assert got[6][2:] == ("net/de/", "allow") and got[7][2:] == ("example.net/de/8", "block") and got[8][:2] == ("x.org", "") and got[9][:2] == ("b:", "//c/d")


def brute_ranks(seed, links, steps):
    """The same propagation with floats."""
    out, rank = collections.Counter(), {h: s * 0.15 for h, s in seed.items()}
    for a, _, n in links:
        out[a] += n
    start = dict(rank)
    for _ in range(steps):
        new = collections.Counter(start)
        for a, b, n in links:
            new[b] += 0.85 * rank.get(a, 0) * n / out[a]
        rank = new
    return rank


def test_trust_follows_links(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a><A HREF = "//{h}/q">' for h in hosts) + '<a href="/own">'
    data = [(1, "http://bad.com/en/1", ""), (2, "http://farm.io/x", link("bad.com")), (3, "http://good.de/", link("farm.io", "fine.fr")), (4, "http://fine.fr/", ""), (5, "http://mid.eu/", link("farm.io", "fine.fr", "fine.fr"))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.host: r for r in urls.judge(pages).collect()}
    between = urls.edges(pages).collect()
    want = brute_ranks({"bad.com": 1.0}, [(r.dst, r.src, r.links) for r in between], urls.STEPS)
    for host, r in got.items():
        assert r.distrust / urls.UNIT == pytest.approx(want.get(host, 0), abs=1e-4)
    assert got["bad.com"].verdict == "block" and got["fine.fr"].verdict == "allow" and 0 < got["mid.eu"].distrust < got["farm.io"].distrust
    assert urls.judge(pages, block_at=urls.UNIT // 10).where("host = 'farm.io'").first().verdict == "block"
    assert urls.judge(pages.limit(0)).count() == 0


def test_farms_are_blocked(spark):
    """Hosts that only link to a blocked host are blocked, one or many; a few bad links among others and links to what everybody links to block nobody."""
    page = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    data = [("http://bad.com/en/1", page("fine.fr")), ("http://lone.com/en/1", ""), ("http://farm.io/", page("lone.com")), ("http://fine.fr/", ""), *((f"http://farm{i}.io/", page("bad.com")) for i in range(30))]
    data += [("http://blog.fr/", page(*["fine.fr"] * 9, "bad.com")), ("http://fan.fr/", page("fine.fr")), ("http://kept.net/de/1", page("seen.io")), ("http://seen.io/", page("lone.com", "fine.fr"))]
    pages = spark.createDataFrame([(i, *x) for i, x in enumerate(data)], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in urls.judge(pages).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"bad.com", "lone.com", "farm.io", *(f"farm{i}.io" for i in range(30))}


def test_links_in_any_case_and_quotes(spark):
    html = """<a href="http://b.fr/"><A HREF = "//c.fr/q"><a class=x Href='https://D.fr/it"s'><a href=http://e.fr/?q=1><a HREF=//f.fr>x</a><a href= '/own' href=other href="" href=''><a href="http://b.fr/'2'">"""
    pages = spark.createDataFrame([(1, "http://a.fr/", html), (2, "http://b.fr/", "<a href='http://a.fr'>"), (3, "http://c.fr/", None)], "page_id long, url string, html string")
    assert sorted(map(tuple, urls.edges(pages).collect())) == [("a.fr", "b.fr", 2), ("a.fr", "c.fr", 1), ("a.fr", "d.fr", 1), ("a.fr", "e.fr", 1), ("a.fr", "f.fr", 1), ("b.fr", "a.fr", 1)]


def test_trust_converges(spark):
    """A ring of hosts settles at its closed form and is blocked; a graph with cycles at the solution of its linear equations."""
    page = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    ring = [(f"http://r{i}.com/{'en' if k < 3 else 'xx'}/{k}", page(f"r{(i + 1) % 6}.com") if k == 19 else "") for i in range(6) for k in range(20)]
    pages = spark.createDataFrame([(i, *x) for i, x in enumerate(ring)], "page_id long, url string, html string")
    free = urls.judge(pages).where("rule is null").collect()
    assert len(free) == 6 * 17 and {r.verdict for r in free} == {"block"} and all(r.distrust / urls.UNIT == pytest.approx(0.15, abs=1e-5) for r in free)
    r = random.Random(11)
    n = 12
    data = [(f"http://h{i}.{'com/en' if i < 2 else 'net/de' if i < 4 else 'fr/x'}/", [r.randrange(n) for _ in range(4)] + [(i + 1) % n]) for i in range(n)]
    name = [u.split("/")[2] for u, _ in data]
    pages = spark.createDataFrame([(i, u, page(*(name[t] for t in to))) for i, (u, to) in enumerate(data)], "page_id long, url string, html string")
    links = np.zeros((n, n))
    for i, (_, to) in enumerate(data):
        for t in to:
            links[i, t] += t != i
    got = {r.host: r for r in urls.judge(pages).collect()}
    for kind, a, seeds in (("trust", links, (2, 3)), ("distrust", links.T, (0, 1))):
        want = np.linalg.solve(np.eye(n) - 0.85 * (a / np.maximum(a.sum(1, keepdims=True), 1)).T, [0.15 * (i in seeds) for i in range(n)])
        assert [got[h][kind] / urls.UNIT for h in name] == pytest.approx(want, abs=2e-5)


def test_trust_reaches_hubs(spark):
    """A host that very many allowed hosts link to gathers all their trust without overflow, and the SQL gives the same verdicts."""
    for n in (300, 100_000):
        rows = spark.range(n).selectExpr("id page_id", "concat('http://h', id, '.net/de/') url", "'<a href=\"https://hub.org/\">' html")
        pages = rows.unionByName(spark.createDataFrame([(n, "http://hub.org/", "<a href='//bad.com'>"), (n + 1, "http://bad.com/en/", ""), (n + 2, "http://fan.io/", "<a href=http://bad.com>")], "page_id long, url string, html string"))
        got = {r.host: r for r in urls.judge(pages).where(f"page_id >= {n}").collect()}
        assert got["hub.org"].trust / urls.UNIT == pytest.approx(n * 0.15 * 0.85, rel=1e-6)
        assert got["bad.com"].trust / urls.UNIT == pytest.approx(n * 0.15 * 0.85**2, rel=1e-6)
        assert got["fan.io"].verdict == "block" and got["hub.org"].verdict == "allow"


def test_trust_is_its_sql(spark, tmp_path):
    """Verdicts of a random host graph agree with the SQL, which finds the links and walks over them on its own; links decide some of them."""
    r = random.Random(3)
    hosts = [f"h{i}.{r.choice(['com', 'net', 'fr', 'io', 'org'])}" for i in range(60)]
    path = lambda h: r.choice({"com": ["/en/1", "/x"], "net": ["/de/1", "/x"], "org": ["/es/", "/x"]}.get(h.split(".")[1], ["/x"]))
    quote = lambda x: r.choice([f'href="{x}"', f"HREF = '{x}'", f"Href={x} "])
    data = []
    for i in range(400):
        h = hosts[int(60 * r.random() ** 2)]
        data.append((i, f"http://{h}{path(h)}", " ".join(f"<a {quote(r.choice(['http:', 'https:', '']) + '//' + r.choice(hosts) + '/p')}>" for _ in range(r.randint(0, 2)))))
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = sorted(con.execute(oracles.urls_sql()).fetchall())
    got = sorted(map(tuple, urls.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == want
    alone = {x.page_id: x.verdict for x in urls.judge(pages.withColumn("html", F.lit(""))).collect()}
    assert sum(alone[x[0]] != x[4] for x in got) >= 5


# --- toxicity ----------------------------------------------------------------------------------------------------------


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.uniform(size=6000) < 0.15
    votes = []
    for hit, miss in ((0.9, 0.02), (0.6, 0.01), (0.6, 0.01)):
        votes.append(np.where(truth, rng.uniform(size=6000) < hit, rng.uniform(size=6000) < miss).astype(int))
    v = np.stack([*votes, votes[2], np.where(sum(votes) == 0, -1, 0)], 1)
    counts = collections.Counter(map(tuple, v.tolist()))
    posterior, weights = toxicity.label_model([(list(k), n) for k, n in counts.items()])
    of = dict(zip(counts, posterior, strict=True))
    q = np.array([of[tuple(x)] for x in v.tolist()])
    assert ((q > 0.5) == truth).mean() > 0.95 and weights[0][1] > 1
    share = toxicity._discount(v == 1, np.ones(len(v)), q)
    assert share[2] < share[0]  # the doubled voter counts less


@pytest.mark.parametrize(("sf", "found", "wrong"), [("sf0.01", 0.5, 0.01), ("sf0.1", 0.92, 0.006)])
def test_toxicity_held_out(spark, sf, found, wrong):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n.get((1, 1), 0) >= found * (n.get((1, 1), 0) + n.get((1, 0), 0)) and n.get((0, 1), 0) <= wrong * n[0, 0]


def test_toxicity_scores_by_definition(docs):
    """Scores are the logistic function of the weighted inputs, counted here one by one."""
    r = np.random.default_rng(5)
    model = toxicity.Model(np.where(r.uniform(size=toxicity.HASHES + 2) < 0.3, r.normal(size=toxicity.HASHES + 2), 0.0))
    w = model.weights.astype(np.float32).astype(float)
    for got in docs.select("text", model.score(F.col("text")).alias("score")).collect():
        words = set(re.findall("[a-z0-9\u0080-\U0010ffff]+", (got.text or "").lower()))
        inputs = collections.Counter(zlib.crc32(x.encode()) % toxicity.HASHES for t in words for x in {f" {t} "} | {f" {t[:k]}" for k in (3, 4, 5) if len(t) >= k})
        z = w[-1] + w[-2] * any(t in toxicity.INSULTS for t in words) + sum(w[h] * np.log1p(100 * c / max(50, len(words))) for h, c in inputs.items())
        assert got.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-9)


def test_linear_model_is_its_optimum():
    """The fitted weights leave no slope; a dense solver by Newton steps finds the same."""
    r = np.random.default_rng(2)
    n, k = 80, 6
    x = np.where(r.uniform(size=(n, k)) < 0.5, r.uniform(0.2, 2, (n, k)), 0.0)
    y, weight, fixed = r.uniform(size=n), r.uniform(0.5, 2, n), (r.uniform(size=n) < 0.2).astype(float)
    row, at = np.nonzero(x)
    got = toxicity.fit_linear(row, at, x[row, at], fixed, y, weight, ridge=0.05)
    dense, pull = np.hstack([x, fixed[:, None], np.ones((n, 1))]), np.array([0.05] * k + [0.0005, 0.0])
    w, share = np.zeros(k + 2), weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-dense @ w))
        w = w - np.linalg.solve((dense * (share * p * (1 - p))[:, None]).T @ dense + np.diag(pull), dense.T @ (share * (p - y)) + pull * w)
    assert np.append(got[:k], got[-2:]) == pytest.approx(w, abs=0.05) and not got[k:-2].any()


def test_labels_that_differ_count_as_toxic(spark):
    texts = [(i, f"plain words number{i} " + ("grubble" if i % 2 else "") + " here") for i in range(60)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert " grubble " in toxicity.lexicon(docs, labels)["word"]


def test_toxicity_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(d, 1, d % 2) for d in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in rows if d is not None}
    nothing = spark.createDataFrame([], labels.schema)
    insults = table(spark, [(1, "you stupid idiot and moron"), (2, "a kind text"), (3, None)])
    assert {r.doc_id: r.predicted for r in toxicity.score(insults, nothing).collect()} == {1: 1, 2: 0, 3: 0}
    assert toxicity.clean(insults, nothing).columns == insults.columns and {r.doc_id for r in toxicity.clean(insults, nothing).collect()} == {2, 3}
    assert toxicity.score(empty, nothing).count() == 0


# --- edges for all -----------------------------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (substring.digests(empty), jaccard.join(empty), licenses.scan(empty), mixing.mix(empty), mixing.apply(empty), quality.judge(empty), jaccard.one_of_each(empty), decontaminate.contaminated(empty, bench), decontaminate.clean(empty, bench), tokens.encode_table(empty, tokenizer_path(), spark)):
        assert df.count() == 0


def test_edge_rows_keep_their_place(docs, rows):
    for df in (licenses.scan(docs), quality.judge(docs), jaccard.join(docs)):
        assert collections.Counter(r.doc_id for r in df.select("doc_id").collect()) == collections.Counter(d for d, _ in rows)


def test_native_plans_have_no_python(spark):
    for name in ("op1_url_trust", "op2_quality_votes", "op6_mix_sources"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_release(spark):
    from quillon.llm import common

    held, common._STAGED[:] = list(common._STAGED), []
    df = stage(spark.range(3), "gone")
    assert df.count() == 3 and common.release(spark) == 1 and common.release(spark) == 0
    with pytest.raises(Exception, match="(?i)file|path"):
        df.count()
    common._STAGED[:] = held
