import random

import numpy as np
import pytest

from tallyloom.llm import suffix_dedup


def plain(rows, length=50):
    """[(id, bytes, removed, spans, kept)] by a table of all strings; a null id comes after all others."""
    def key(i):
        return suffix_dedup.NO_ID if i is None else i

    least = {}
    data = [(i, (text or "").encode()) for i, text in rows]
    for i, b in data:
        for j in range(len(b) - length + 1):
            s = b[j : j + length]
            least[s] = min(least.get(s, suffix_dedup.NO_ID), key(i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if least[b[j : j + length]] < key(i):
                gone[j : j + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((-1 if i is None else i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, data string, grp int")


def result(df):
    return sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3], bytes(r[4])) for r in df.collect())


def corpus(seed, n=60):
    """Texts of syllables with shared passages, near copies, exact copies and periodic runs."""
    rng = random.Random(seed)
    parts = ["tion", "ing", "er", "an", "th", "ß", "的", "e ", " on", ". "]

    def prose(k):
        return "".join(rng.choice(parts) for _ in range(k))

    passages = [prose(rng.randint(10, 90)) for _ in range(8)]
    rows = []
    for i in range(n):
        text = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            text += p[cut:] + prose(rng.randint(0, 30))
        rows.append((i * 3, text))
    for i in range(12):
        text = list(rows[rng.randrange(n)][1])
        for _ in range(rng.randint(0, 2)):
            if text:
                text[rng.randrange(len(text))] = "Q"
        rows.append((1000 - i, "".join(text)))
    return rows + [(2000, "ab" * 80), (2001, "ba" * 60), (2002, "a" * 200), (2003, "a" * 49), (2004, "a" * 50), (2005, "x" + "a" * 60 + "y")]


@pytest.mark.parametrize(("seed", "group", "block"), [(1, 8 << 20, 1 << 20), (2, 500, 1 << 20), (3, 2000, 1 << 20)])
def test_equal_to_a_table_of_all_strings(spark, monkeypatch, seed, group, block):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    rows = corpus(seed)
    assert result(suffix_dedup.drop_repeats(frame(spark, rows).repartition(5))) == plain(rows)


def test_other_lengths(spark):
    rows = corpus(4, 30)
    for length in (19, 33, 80):
        assert result(suffix_dedup.drop_repeats(frame(spark, rows), length=length)) == plain(rows, length)
    with pytest.raises(ValueError):
        suffix_dedup.drop_repeats(frame(spark, rows), length=18)


def test_nulls_repeated_ids_and_empty_tables(spark):
    rows = [(None, "z" * 30 + "q" * 40), (None, "q" * 60), (1, None), (2, ""), (3, "short"), (4, "q" * 20 + "w" * 50), (4, "q" * 20 + "w" * 50), (5, "w" * 50), (6, "q" * 20 + "w" * 50)]
    rows += [(7, "abcdefghij" * 9), (None, "abcdefghij" * 9), (None, "\0" * 70), (8, "\0" * 60)]
    assert result(suffix_dedup.drop_repeats(frame(spark, rows))) == plain(rows)
    assert suffix_dedup.drop_repeats(frame(spark, [])).count() == 0
    with pytest.raises(TypeError):
        suffix_dedup.drop_repeats(frame(spark, rows), id_col="text")


def test_many_rows_of_one_id_lie_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 300)
    shared = "a passage that a smaller document has as well, and long enough to count, "
    rows = [(1, "start " + shared + "end")] + [(5, f"{k} " + shared + f"{k} own words of the row {k * 7919}, more of them {k}") for k in range(30)]
    rows += [(None, f"{k} " + shared + f"without an id {k * 104729} and so on {k}") for k in range(30)]
    assert result(suffix_dedup.drop_repeats(frame(spark, rows).repartition(4))) == plain(rows)


def test_very_long_texts_are_parsed_in_blocks(spark):
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 123, suffix_dedup.BLOCK + 3000, dtype=np.uint8)).decode()
    rows = [(1, long), (2, "head " + long[suffix_dedup.BLOCK - 700 : suffix_dedup.BLOCK + 500]), (3, long[10:])]
    got = result(suffix_dedup.drop_repeats(frame(spark, rows)))
    assert [r[:4] for r in got] == [(1, len(long), 0, 0), (2, 1205, 1200, 1), (3, len(long) - 10, len(long) - 10, 1)]
    assert got[1][4] == b"head "


def test_a_string_has_its_trigger_at_the_same_place_everywhere():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 3, 400, dtype=np.uint8)
    p = suffix_dedup.Phrases(data, 50)
    assert p.first[0] == 0 and p.last[-1] == 350 and (p.first[1:] == p.last[:-1] + 1).all()
    assert ((p.at >= p.last) & (p.at - p.first <= 32)).all()
    for start in range(0, 351, 7):
        own = suffix_dedup.Phrases(data[start : start + 50], 50)
        inside = np.flatnonzero((p.first <= start) & (start <= p.last))[0]
        assert own.at[0] + start == p.at[inside]


def test_query_on_whole_documents(spark):
    import hashlib
    from pathlib import Path

    from tallyloom.llm import queries

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test data")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op11_suffix_dedup(spark, str(folder)).collect())
    assert got == [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in plain(rows)]
