"""Sharding, mixing, near-duplicates and syncmers against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lintlake.llm import common, mixing, near_copies, sharding, simhash, syncmers


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# Sharding.


def check_shards(docs, found, shards):
    rows = found.collect()
    texts = [r.text or "" for r in docs.collect()]
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.law, r.grown_shard) == ("rows", None)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    return rows


def test_shards_keep_groups(make_docs):
    rng = random.Random(1)
    texts = [f"text {i}" for i in range(400)] + [f"copied {i % 40}" for i in range(160)] + ["hot"] * 300
    rng.shuffle(texts)
    docs = make_docs(list(enumerate(texts)))
    rows = check_shards(docs, sharding.shard_documents(docs, shards=10), 10)
    places = defaultdict(Counter)
    for r in rows:
        places[r.text_crc32][r.shard] += 1
    apart = sum(sum(c.values()) - max(c.values()) for k, c in places.items() if k != zlib.crc32(b"hot"))
    assert apart <= 8  # of 160 documents in small groups
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(docs, shards=10).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_shards_exchange_groups(make_docs):
    """Every row in a group of ten, so that no shard has room to begin with."""
    rng = random.Random(4)
    texts = [f"text {i % 800}" for i in range(8000)]
    rng.shuffle(texts)
    docs = make_docs(list(enumerate(texts)))
    places = defaultdict(Counter)
    for r in check_shards(docs, sharding.shard_documents(docs, shards=40), 40):
        places[r.text_crc32][r.shard] += 1
    assert sum(max(c.values()) for c in places.values()) >= 7200


def test_labels_against_all_labellings(spark):
    """On small tables no labelling under the quota leaves fewer links cut."""
    rng = random.Random(6)
    for _ in range(4):
        sizes = [rng.randint(2, 4) for _ in range(5)]
        rows = [(f"g{g}", rng.randrange(3)) for g, n in enumerate(sizes) for _ in range(n)]
        quota = -(-sum(sizes) // 3) + 2
        found = sharding.propagate(spark.createDataFrame(rows, "link string, shard int"), 3, quota).collect()
        load = Counter()
        for r in found:
            load[r.label] += sizes[int(r.link[1:])]
        assert max(load.values()) <= quota and len({r.link for r in found}) == len(found)
        possible = [
            labels for labels in itertools.product(range(3), repeat=5)
            if all(sum(n for n, x in zip(sizes, labels) if x == s) <= quota for s in range(3))
        ]
        assert possible and len(found) == 5  # whole groups only: no link is cut


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_shards_of_odd_rows(odd_docs, shards):
    check_shards(odd_docs, sharding.shard_documents(odd_docs, shards=shards), shards)


def test_no_shards_of_nothing(make_docs):
    assert sharding.shard_documents(make_docs([])).count() == 0


# Mixing.


def brute_targets(sizes, most=3.0, weights=(1, 2, 3)):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    stopped: dict = {}
    while True:
        left = sum(sizes.values()) - sum(stopped.values())
        share = sum(w for n, w in weight.items() if n not in stopped)
        target = {n: left * w / share for n, w in weight.items() if n not in stopped} if share else {}
        over = {n: most * sizes[n] for n, t in target.items() if t > most * sizes[n]}
        if not over:
            return stopped | target
        stopped |= over


def test_targets_and_taken_words(make_docs):
    rng = random.Random(2)
    sources = ["hot"] * 300 + ["b", "é", "Z", None, "tiny"] * 30
    rows = [(i, words(rng, 1 if s == "tiny" else rng.randint(0, 60)), s) for i, s in enumerate(sources)]
    sizes = Counter()
    for _, text, s in rows:
        sizes[s] += len(text.split())
    wanted = brute_targets(sizes)
    found = mixing.mix(make_docs(rows), block=50).collect()
    taken = Counter()
    for r in found:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= 12, (s, taken[s], target)
    again = {(r.doc_id, r.copies) for r in mixing.mix(make_docs(rows).repartition(3), block=50).collect()}
    assert again == {(r.doc_id, r.copies) for r in found}
    mixed = mixing.mixed_documents(make_docs(rows), block=50)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in found if r.copies})


def test_flight_keeps_totals():
    random_ = np.random.default_rng(5)
    share, rows, size = random_.random(400), random_.integers(1, 3, 400), random_.integers(0, 900, 400)
    flown = mixing.fly(share, rows, size, np.random.default_rng(1))
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown @ rows == pytest.approx(share @ rows) and flown @ size == pytest.approx(share @ size)
    # Every unit keeps its chance: the mean over many flights is the share.
    small, ones = np.full(12, 0.3), np.ones(12, int)
    mean = np.mean([mixing.fly(small, ones, np.arange(12) % 4, np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.04


def test_mixing_odd_rows(odd_docs, make_docs):
    found = mixing.mix(odd_docs)
    assert found.agg(F.sum("rows")).first()[0] == odd_docs.count()
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mix(make_docs([])).count() == 0


# SimHash.


def plain_fingerprint(text):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


@pytest.mark.parametrize("crowded", [1000, 1])
def test_near_duplicates(make_docs, crowded):
    rng = random.Random(4)
    rows = []
    for base in range(12):
        text = words(rng, 200).split()
        rows += [" ".join(text)] * 3
        for _ in range(12):
            changed = list(text)
            for _ in range(rng.randint(1, 4)):
                changed[rng.randrange(len(changed))] = f"w{rng.randrange(300)}"
            rows.append(" ".join(changed))
    rows += ["", None, "One Two", "one  two", "x"]
    ids = [7 * i - 50 for i in range(len(rows))]
    rng.shuffle(ids)
    prints = [plain_fingerprint(t) for t in rows]
    label = brute_components(prints)
    least = defaultdict(lambda: 10**9)
    for i, x in zip(ids, label):
        least[x] = min(least[x], i)
    found = {r.doc_id: r for r in simhash.near_duplicates(make_docs(list(zip(ids, rows))), crowded=crowded).collect()}
    assert len(found) == len(rows)
    for i, p, x in zip(ids, prints, label):
        assert (found[i].fingerprint, found[i].component_id) == (f"{p:016x}", least[x])
    kept = simhash.representatives(make_docs(list(zip(ids, rows)))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))


def test_close_fingerprints_share_a_key(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 3, 4)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    table = spark.createDataFrame(signed, "fingerprint long")
    wanted = {(a[0], b[0]) for a in signed for b in signed if a < b and bin((a[0] ^ b[0]) & (1 << 64) - 1).count("1") <= 3}
    for crowded in (1000, 0):
        assert {tuple(r) for r in simhash.links(table, crowded).collect()} == wanted


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 99)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(pairs).collect()} == {i: 0 for i in range(41)} | {99: 99, 100: 99, 101: 99}


def test_near_duplicates_of_odd_rows(odd_docs, make_docs):
    found = simhash.near_duplicates(odd_docs)
    assert found.count() == odd_docs.count()
    assert {r.component_id for r in found.where("fingerprint = '0000000000000000'").collect()} == {1}
    assert simhash.representatives(odd_docs).groupBy("doc_id", "text").count().where("count > 1").count() == 0
    assert simhash.near_duplicates(make_docs([])).count() == 0


# Near copies by shingles.


def shingles(text):
    own = text.split()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def planted(rng, bases, size=300):
    """Texts in groups: of each base some copies with one to nine words changed."""
    rows = []
    for _ in range(bases):
        text = words(rng, size, 5000).split()
        rows.append(" ".join(text))
        for n in range(1, 10):
            changed = list(text)
            for k in rng.sample(range(size), n):
                changed[k] = "new"
            rows.append(" ".join(changed))
    return rows


def components_of(pairs, n):
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in pairs:
        low, high = sorted((find(i), find(j)))
        root[high] = low
    return [find(i) for i in range(n)]


def alike_pairs(rows):
    """All pairs of 0.8 or more, found by their common shingles."""
    own = [shingles(t) for t in rows]
    having = defaultdict(list)
    for i, shingle_set in enumerate(own):
        for shingle in shingle_set:
            having[shingle].append(i)
    common = Counter((i, j) for listed in having.values() for j in listed for i in listed if i < j)
    return {(i, j) for (i, j), n in common.items() if n >= 0.8 * (len(own[i]) + len(own[j]) - n)}


def linked(make_docs, rows):
    """(links, pairs compared) as row numbers, and how many links are not alike."""
    docs = make_docs(list(enumerate(rows)))
    sets = near_copies.with_sets(docs).withColumn("row_key", common.row_key())
    number = {r.set_key: r.doc_id for r in sets.select("set_key", "doc_id").collect()}
    found = near_copies.near_links(docs, sets)
    return [{tuple(sorted((number[r.a], number[r.b]))) for r in df.collect()} for df in found]


@pytest.mark.parametrize("rounds", [near_copies.ROUNDS, 0])
def test_near_copies_are_connected(make_docs, monkeypatch, rounds):
    """Recall on planted near copies; with no rounds in bands all goes by rare shingles, where no link is lost."""
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rows = planted(random.Random(12), 30)
    alike = alike_pairs(rows)
    prints = [plain_fingerprint(t) for t in rows]
    assert sum(bin(prints[i] ^ prints[j]).count("1") > 3 for i, j in alike) > 300  # what op5's distance misses
    links, pairs = linked(make_docs, rows)
    assert links <= alike and links <= pairs
    assert components_of(links, len(rows)) == components_of(alike, len(rows))


def test_batches_are_taken_in_pieces(spark, make_docs):
    """Workers hold rows of about so many bytes as Python values, each row once, and what is dropped does not come back."""
    texts = [None, "", "x" * 50_000, *("y" * (n % 400) for n in range(3000))]
    docs = make_docs(list(enumerate(texts))).coalesce(1)

    def compute(values):
        return {"chars": [len(v or "") for v in values], "held": [sum(len(v or "") for v in values)] * len(values)}

    kinds = {"chars": LongType(), "held": LongType()}
    rows = common.with_batch_columns(docs, ["text"], kinds, compute, 10_000, ("Text",)).collect()
    assert sorted((r.doc_id, r.chars) for r in rows) == [(i, len(t or "")) for i, t in enumerate(texts)]
    assert "text" not in rows[0].asDict() and max(r.held for r in rows) < 70_000
    whole = common.with_batch_columns(docs, ["text"], kinds, compute).collect()
    assert {r.held for r in whole} == {sum(r.chars for r in rows)} and [r.text for r in whole] == texts
    assert common.with_batch_columns(docs.where("false"), ["text"], kinds, compute, 10_000, ("text",)).count() == 0


def test_near_duplicates_take_pieces(make_docs, monkeypatch):
    """Both passes over texts are made in pieces and send no text back."""
    given = []

    def noted(df, inputs, outputs, compute, piece_bytes=None, drop=()):
        found = common.with_batch_columns(df, inputs, outputs, compute, piece_bytes, drop)
        given.append((piece_bytes, "text" in found.columns))
        return found

    for module in (simhash, near_copies):
        monkeypatch.setattr(module, "with_batch_columns", noted)
    assert simhash.representatives(make_docs([(i, t) for i, t in enumerate(planted(random.Random(3), 2))]), similar=True).count() > 0
    assert given == [(common.PIECE_BYTES, False)] * 2


@pytest.mark.parametrize(("changes", "size"), [(5, 400), (6, 100)])
def test_large_groups_are_compared_with_their_heads(make_docs, changes, size):
    """A crowd of copies of one text that are not alike among themselves: few comparisons, one component (none, if just not alike)."""
    rng = random.Random(14)
    base = words(rng, 240, 5000).split()
    rows = [" ".join(base)]
    for n in range(size):
        changed = list(base)
        for k in rng.sample(range(0, 240, 8), changes):
            changed[k] = f"new{n}x{k}"
        rows.append(" ".join(changed))
    alike = alike_pairs(rows)
    links, pairs = linked(make_docs, rows)
    assert components_of(links, len(rows)) == components_of(alike, len(rows))
    assert changes > 5 or len(links) <= len(pairs) < 10 * len(rows)


def test_near_copies_that_are_not_alike_are_not_led_past_each_other(make_docs, monkeypatch):
    """Copies of a text that is not there, a few changes each, over half of them linked to nothing: two rounds of heads, then one comparison."""
    rng = random.Random(16)
    base = words(rng, 150, 5000).split()
    rows = []
    for n in range(300):
        changed = list(base)
        for k in rng.sample(range(150), 1 + n % 7):
            changed[k] = f"new{n}x{k}"
        rows.append(" ".join(changed))
    tables = Counter()

    def counted(df, name):
        found = common.written(df, name)
        tables[name] += found.count()
        tables[name, "times"] += 1
        return found

    monkeypatch.setattr(near_copies, "written", counted)
    alike = alike_pairs(rows)
    parts = components_of(alike, len(rows))
    assert sum(n == 1 for n in Counter(parts).values()) > 100
    links, pairs = linked(make_docs, rows)
    assert links <= alike and links <= pairs and components_of(links, len(rows)) == parts
    assert len(pairs) < 10 * len(rows)
    assert tables["near-met", "times"] <= 2 and tables["near-met"] <= 2 * tables["near-active"]


def test_forms_are_not_paired_off(make_docs):
    """Texts of a common form, which are not alike, with some that are planted."""
    rng = random.Random(15)
    form = words(rng, 160, 5000).split()
    rows = [" ".join([*form[:80], *words(rng, 45, 50000).split(), *form[80:]]) for _ in range(1000)]
    for n in range(50):
        changed = rows[n].split()
        changed[85] = "other"
        rows.append(" ".join(changed))
    alike = alike_pairs(rows)
    assert len(alike) == 50
    links, pairs = linked(make_docs, rows)
    assert links <= alike and len(links) >= 49
    assert len(pairs) < 30 * len(rows)


def test_representatives_of_near_copies(make_docs, odd_docs):
    rows = planted(random.Random(13), 12, 500)
    kept = simhash.representatives(make_docs(list(enumerate(rows))), similar=True).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 120, 10))
    assert len(simhash.representatives(make_docs(list(enumerate(rows)))).collect()) > 24
    assert simhash.representatives(odd_docs, similar=True).groupBy("doc_id", "text").count().where("count > 1").count() == 0


# Syncmers.


def edits(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following, half = text or "", following or "", len(text or "") // 2
        yield i, text, text[: len(text) - half] + following[:half], following


def plain_kept(text):
    """{hash: first place} of the anchors that a fingerprint keeps, and up to which hash it is complete."""
    first = {}
    for place, h in zip(*(x.tolist() for x in syncmers.anchors_of(*syncmers.codes_of([text])))):
        first.setdefault(h, place)
    least = sorted(first)[: syncmers.LEAST]
    kept = {h: p for h, p in first.items() if h in least or h < 2**32 // syncmers.SHARE}
    return kept, 2**32 if len(kept) < syncmers.LEAST else max(2**32 // syncmers.SHARE - 1, *kept)


def plain_likeness(left, right):
    (a, a_bound), (b, b_bound) = plain_kept(left), plain_kept(right)
    if not a or not b:
        return float(not a and not b)
    counted = []
    for kept in (a, b):
        listed = [(h, p) for h, p in kept.items() if h <= min(a_bound, b_bound)]
        counted.append({h for h, _ in listed} | {(g, h, q - p) for (g, p), (h, q) in zip(listed, listed[1:])})
    return len(counted[0] & counted[1]) / max(1, len(counted[0] | counted[1]))


@pytest.mark.parametrize("partitions", [1, 5])
def test_compare_with_next(make_docs, partitions):
    rng = random.Random(8)
    rows = [(rng.randrange(10**12), words(rng, rng.randint(0, 80))) for _ in range(120)] + [(5, None), (6, "é漢" * 9)]
    found = {r.doc_id: r for r in syncmers.compare_with_next(make_docs(rows), partitions).collect()}
    assert len(found) == len(rows)
    better = 0
    for i, text, edited, following in edits(rows):
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(plain_likeness(text, edited))
        assert r.near_next == pytest.approx(plain_likeness(text, following))
        better += r.near_edited > r.near_next
    assert better > 0.9 * len(rows)


def test_anchors_are_context_free():
    rng = random.Random(9)
    middle = words(rng, 60)
    codes = [syncmers.anchors_of(*syncmers.codes_of([t])) for t in (middle, "before " + middle + " after")]
    inner = {int(h) for p, h in zip(*codes[0]) if p > 0}
    assert inner <= {int(h) for h in codes[1][1]}
    plain = set()
    text = np.array([ord(c) for c in middle], np.uint32)
    bounds = np.array([0, len(text)])
    for at in range(1, len(text) - syncmers.K + 1):
        own = syncmers.anchors_of(text[at - 1 : at + syncmers.K], np.array([0, syncmers.K + 1]))[0]
        plain |= {at} if 1 in own.tolist() else set()
    assert plain == {int(p) for p in syncmers.anchors_of(text, bounds)[0] if p > 0}


def test_long_texts_with_a_common_passage():
    rng = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyz     "

    def made(size):
        return "".join(rng.choices(letters, k=size))

    for _ in range(20):
        passage, places = made(400), (rng.randrange(19_000), rng.randrange(19_000))
        with_it = [made(at) + passage + made(19_600 - at) for at in places]
        a, b, c = syncmers.sketches([*with_it, made(20_000)])
        assert syncmers.likeness(a, b) > 0 and syncmers.likeness(a, c) == 0 == syncmers.likeness(b, c)


def test_order_and_distance_count():
    rng = random.Random(12)
    parts = [words(rng, 40, 10_000) for _ in range(12)]
    text, turned = " ".join(parts), " ".join(rng.sample(parts, 12))
    own, same, other = syncmers.sketches([text, text + " end", turned])
    assert syncmers.likeness(own, same) > syncmers.likeness(own, other) > 0


def test_hot_id_is_split(make_docs):
    rng = random.Random(11)
    rows = [(i, words(rng, 30)) for i in range(60)] + [(30, words(rng, 30)) for _ in range(80)] + [(7, "same")] * 30
    docs = make_docs(rows)
    placed = syncmers.with_next(docs, 8).where("ahead = 0").select("doc_id", "bucket", "text").collect()
    assert len({r.bucket for r in placed if r.doc_id == 30}) > 2 and len({r.bucket for r in placed if r.text == "same"}) == 1
    found = syncmers.compare_with_next(docs, 8).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    # Rows of one id may follow each other in any order, but each is followed by a row of its own id or the first of the next.
    for r in found:
        nexts = texts[r.doc_id] + texts[(r.doc_id + 1) % 60]
        possible = {hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t in texts[r.doc_id] for n in nexts}
        assert r.edited_sha256 in possible
    assert Counter(r.edited_sha256 for r in found)[hashlib.sha256(b"sasa").hexdigest()] >= 29


def test_likeness():
    a, b = syncmers.sketches(["a b c d e f g h i j k l m n", ""])
    assert syncmers.likeness(a, a) == syncmers.likeness(b, b) == 1.0 and syncmers.likeness(a, b) == 0.0


def test_syncmers_of_odd_rows(odd_docs, make_docs):
    assert syncmers.compare_with_next(odd_docs).count() == odd_docs.count()
    one = syncmers.compare_with_next(make_docs([(1, "alone")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"aloal").hexdigest()
    assert syncmers.compare_with_next(make_docs([])).count() == 0
    assert syncmers.with_fingerprint(odd_docs).count() == syncmers.with_anchors(odd_docs).count() == odd_docs.count()
