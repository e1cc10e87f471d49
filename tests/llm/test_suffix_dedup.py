import hashlib

import numpy as np
import pytest

from keystrata.llm import suffix_dedup as s


def brute(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abé "), rng.integers(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages, rows = [prose(40) for _ in range(6)], []
    for i in range(n):
        kind = rng.integers(0, 6)
        t = prose(int(rng.integers(0, 80)))
        if kind == 1:
            p = passages[rng.integers(0, 6)]
            a = rng.integers(0, 60)
            t = t + p[a:] + prose(5)
        elif kind == 2 and rows:
            t = rows[rng.integers(0, len(rows))][1] or ""
            k = rng.integers(0, len(t) + 1)
            t = t[:k] + "X" + t[k:]
        elif kind == 3:
            t = (word() + " ") * int(rng.integers(1, 90))
        rows.append((int(i * 37 % 1009), t))
    return rows


@pytest.mark.parametrize("seed,length,seed_bytes,batch", [(1, 100, 32, 1 << 16), (2, 40, 12, 50), (3, 100, 32, 200), (4, 33, 8, 7)])
def test_matches_brute_force(spark, monkeypatch, seed, length, seed_bytes, batch):
    rows = corpus(seed) + [(5000, None), (5001, ""), (5002, "z" * 2000), (5003, "z" * 1500), (5004, "long " * 4000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lo string").repartition(5)
    monkeypatch.setattr(s, "BATCH", batch)
    got = sorted(map(tuple, s.digests(df, length, seed_bytes).collect()))
    assert got == brute(rows, length)


def test_family_levels_are_geometric_and_exact():
    rng = np.random.default_rng(3)
    family, seen = s.SuffixFamily(), set()
    for start in range(0, 3000, 100):
        run = rng.integers(0, 1500, 100).astype(np.uint64)
        again = family.add(run, run * np.uint64(3), np.arange(start, start + 100))
        for r, a in zip(run.tolist(), again.tolist(), strict=True):
            assert a == (r in seen)
            seen.add(r)
        sizes = [len(x[0]) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_stage_cuts_whole_characters_and_drops_emptied_rows(spark):
    text = "".join(chr(0xE0 + i % 30) + chr(0x4E00 + i) for i in range(100))
    rows = [(1, text, 7, "a"), (2, "x" + text + "y", 7, "b"), (3, text, 7, "c"), (4, "", 7, "d"), (5, None, 7, "e"), (1, text, 7, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = s.without_repeats(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect() if r.doc_id != 5)
    assert got == [(1, text, 200), (1, text, 200), (2, "xy", 2), (4, "", 0)]
    assert s.digests(df.limit(0)).count() == 0


def test_null_ids_and_one_exchange_of_texts(spark):
    text = "".join(chr(0x4E00 + i) for i in range(100))
    df = spark.createDataFrame([(None, text), (1, text)], "doc_id long, text string")
    out = s.digests(df)
    assert sorted((r.doc_id is None, r.n_removed) for r in out.collect()) == [(False, 300), (True, 0)]


def test_strings_of_equal_hash_are_told_apart():
    """With keys that all clash, byte comparison alone finds the earlier strings."""
    rng = np.random.default_rng(8)
    for length in (3, 8, 11, 40):
        buf = rng.integers(97, 99, 700).astype(np.uint8)
        buf[400:600] = buf[50:250]
        at = np.arange(len(buf) - length + 1)
        doc, place = at // 90, (at % 90).astype(np.int32)
        got = s.later_strings(buf, at, np.zeros(len(at), np.uint64), doc, place, length)
        seen = set()
        for k in at.tolist():
            w = bytes(buf[k : k + length])
            assert got[k] == (w in seen)
            seen.add(w)


def test_different_texts_of_one_id_and_clashing_names(spark):
    rng = np.random.default_rng(2)
    a, b, c = ("".join(rng.choice(list("abcdefgh "), 231)) for _ in range(3))
    rows = [(1, a), (1, a), (1, b + a), (None, c), (None, b + c), (7, "x" + b), (8, "short")]
    names = "doc_id long, text string, _ks_id int, _ks_key int, _ks_spans int, _ks_runs int"
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], names).repartition(3)
    got = {(r.doc_id, r.n_bytes): r for r in s.digests(df).collect()}
    assert all(r.n_removed <= r.n_bytes for r in got.values())
    # Whichever text of an id comes first by hash, each string stays once.
    assert got[(1, 231)].n_removed + got[(1, 462)].n_removed == 231 + 231 and got[(None, 231)].n_removed + got[(None, 462)].n_removed == 231 and got[(7, 232)].n_removed == 231
    kept = s.without_repeats(df)
    assert kept.columns == df.columns and all(r[2:] == (1, 2, 3, 4) for r in kept.collect())


def test_runs_stay_open_only_beside_runs_that_may_share_a_window(spark):
    """Short strings that many texts hold by chance take no disk: their runs go with whole-run fingerprints alone."""
    rng = np.random.default_rng(12)
    prose = lambda k: "".join(rng.choice(list("abcdefghij "), k))
    short, passage = prose(60), prose(300)
    rows = [(i, prose(200) + short + prose(200)) for i in range(80)] + [(100 + i, prose(150) + passage[i : i + 160] + prose(150)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = df.repartition(3).mapInArrow(s.map_runs(100, 32), s.RUNS).repartition(1)
    found = runs.mapInArrow(s.scan_family, "doc_id bigint, lo int, n int, repeated boolean, anchor int").where("not repeated")
    opened = {r.doc_id for r in found.select("doc_id").collect()}
    assert not any(i < 100 for i in opened) and len(opened) > 30
    assert sorted(map(tuple, s.digests(df).collect())) == brute(rows, 100)


@pytest.mark.parametrize("length,seed", [(100, 32), (40, 12), (33, 8), (9, 8), (8, 8)])
def test_runs_that_share_a_window_agree_in_a_side(length, seed):
    rng = np.random.default_rng(length)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    for at in range(1000, 3600, 400):
        k = int(rng.integers(length, 300))
        buf[at : at + k] = buf[500 : 500 + k]
    offsets = np.array([0, 700, 710, 2500, 4000])
    doc, lo, n, anchor, prints, side = s.anchored_runs(buf, offsets, length, seed)
    raw, short = buf.tobytes(), (anchor >> np.uint64(32)).astype(np.uint32).view(np.int32)
    windows = [{raw[a : a + length] for a in range(x, x + k)} for x, k in zip(lo.tolist(), n.tolist(), strict=True)]
    for i in range(len(lo)):
        for j in range(i):
            if windows[i] & windows[j]:
                assert s.shared_sides(short[[i, j]], side[[i, j]]).all()


def test_open_runs_go_in_rounds_whose_texts_stay_a_share_of_the_input(spark, monkeypatch):
    rows, sizes, one = corpus(6), [], s.open_edges
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def counted(docs, opened, names, length):
        sizes.append(sum(r.n + length - 1 for r in opened.collect()))
        return one(docs, opened, names, length)

    monkeypatch.setattr(s, "open_edges", counted)
    whole = sorted(map(tuple, s.digests(df).collect()))
    monkeypatch.setattr(s, "ROUND_BYTES", 1000)
    monkeypatch.setattr(s, "ROUND_SHARE", 0.2)
    assert sorted(map(tuple, s.digests(df).collect())) == whole == brute(rows, 100)
    size = sum(len((t or "").encode()) for _, t in rows)
    assert len(sizes) == 1 - (-sizes[0] // int(0.2 * size)) > 2 and sum(sizes[1:]) == sizes[0]
