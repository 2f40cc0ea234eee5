import collections
import hashlib
import zlib

import pytest

from tallyloom.llm import prefix_trie

HEAD = "conv_id bigint, turn bigint, role string, text string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(x, key=lambda t: t[0])] for c, x in own.items()}


def graft(own):
    return {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + x[h:] for c, x in own.items()}


def plain(seqs):
    """{(smallest member, depth): the rest of the row}."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, x in sorted(seqs.items()):
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
        ends[tuple(x)].append(c)
    kids = collections.defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else -1, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest())
        for n, m in members.items()
    )


def result(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def conversations(n=150, hot=60):
    rows = []
    for c in range(n):
        for t in range(c % 7):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {c * (t + 3) % (2 + t)}"))
    for c in range(1000, 1000 + hot):  # one very common conversation
        rows += [(c, t, "user", "hot" * t) for t in range(5)]
    rows += [(5000, t, "user", f"long {t}") for t in range(700)] + [(5001, t, "user", f"long {t}") for t in range(650)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], HEAD)


@pytest.mark.parametrize(("run_turns", "parts"), [(50_000, None), (40, 7), (1, 1), (13, 40)])
def test_equal_to_plain_version_however_it_is_cut(spark, run_turns, parts):
    rows = conversations()
    got = prefix_trie.prefix_trie(prefix_trie.sequences(frame(spark, rows)), run_turns=run_turns, parts=parts)
    assert result(got) == plain(sequences(rows))


def test_grafted_conversations(spark):
    rows = conversations(450) + [(100, 0, "user", "base"), (100, 1, "user", "base 2")]
    got = prefix_trie.prefix_trie(prefix_trie.grafted(prefix_trie.sequences(frame(spark, rows))), parts=3)
    assert result(got) == plain(graft(sequences(rows)))


def test_nulls_repeats_and_turnless(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 2, "user", None), (8, None, "", ""), (8, 2, "user", ""), (9, 1, "user", "a"), (9, 1, "user", "a"), (-3, 0, "user", "é😀")]
    assert result(prefix_trie.prefix_trie(prefix_trie.sequences(frame(spark, rows)))) == plain(sequences(rows))
    short = [(c, 0, "user", f"t{c}") for c in range(101, 160)]  # no base conversation: most lose their only turn
    got = prefix_trie.prefix_trie(prefix_trie.grafted(prefix_trie.sequences(frame(spark, short))))
    assert result(got) == plain(graft(sequences(short)))


def test_empty_table(spark):
    assert prefix_trie.prefix_trie(prefix_trie.sequences(frame(spark, []))).count() == 0


def test_node_layouts_grow_and_keep_their_children():
    kids, nodes = prefix_trie.Kids(), {}
    for i, byte in enumerate((37 * k) % 256 for k in range(256)):
        nodes[byte] = prefix_trie.Node(bytes([byte]), (b"", ()))
        kids.put(byte, nodes[byte])
        assert kids.room == next(r for r in (4, 16, 48, 256) if i < r)
        assert all(kids.find(b) is n for b, n in nodes.items())
    assert len(list(kids.items())) == 256
    kids = prefix_trie.Kids()
    for byte in range(20):
        kids.put(byte, nodes[byte])
    assert kids.find(21) is None and kids.find(19) is nodes[19]


def test_turns_that_share_bytes_split_inside_a_turn():
    a, b, c = b"\0" * 15 + b"a", b"\0" * 15 + b"b", b"\1" * 16
    items = sorted(((k, (1,) * (len(k) // 16), [(len(k) // 16, (1, i, 0, 0, 0))], i) for i, k in enumerate([a, b, a + c, a + b, a + a])), key=lambda x: (x[0], x[3]))
    nodes, chunks, paths = prefix_trie.fold(items, True, True)
    assert not chunks and not paths
    assert sorted((n[2], n[3], n[4], n[5], n[6], n[7]) for n in nodes) == [(0, 0, None, 5, 2, 4), (1, 0, 0, 4, 3, 3), (1, 1, 0, 1, 0, 1), (2, 2, 0, 1, 0, 1), (2, 3, 0, 1, 0, 1), (2, 4, 0, 1, 0, 1)]
