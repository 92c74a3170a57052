"""Pieces of texts as hashes, and what of the lines travels to a large rule index."""

import numpy as np
import pyarrow as pa

from lynceus.operators import pieces as P
from lynceus.operators import rule_tables
from lynceus.operators.rule_tables import prepared, table_hits
from lynceus.plans.scan import as_files

TEXTS = ["abcabcabcabcabcabc", None, "", "ab", "ſtöp €uro 𝒳yz", "abc"]


def test_pieces_are_all_windows_of_bytes():
    texts = pa.array(["skipped", *TEXTS]).slice(1)
    sizes = (16, 12, 8, 6, 3)
    seen: dict[int, bytes] = {}
    for size, (rows, hashes) in zip(sizes, P.pieces(texts, sizes)):
        want = [(i, t.encode()[k : k + size]) for i, t in enumerate(TEXTS) if t for k in range(len(t.encode()) - size + 1)]
        assert [i for i, _ in want] == rows.tolist()
        for (_, piece), h in zip(want, hashes.tolist()):
            assert seen.setdefault(h, piece) == piece and h % P.KINDS == size % P.KINDS
    assert len(seen) == len(set(seen.values()))


def test_keys_of_a_table_are_always_let_through(spark):
    keys = list(range(0, 3_000_000_000_000, 7_777_777_777))
    mixed = [int(k) for k in P._mixed(np.array(keys, np.uint64)).view(np.int64)]
    known = P.piece_filter(spark.createDataFrame([(k,) for k in mixed], "key bigint"), "key", len(mixed))
    assert len(known.may_hold(np.array(mixed, np.int64).view(np.uint64))) == len(mixed)
    others = P._mixed(np.arange(1, 100_001, dtype=np.uint64) * np.uint64(3))
    assert len(known.may_hold(others)) < 5000


def test_only_lines_with_a_piece_of_a_rule_travel(spark, monkeypatch):
    """A large index once took every line once for each of its pieces."""
    rules = spark.range(300).selectExpr(
        "concat('R', id) AS rule_id", "'sast' AS engine", "CAST(id AS INT) AS ord", "'t' AS title", "concat('^call_', id, '[(]|x = ', id, '$') AS pattern",
        "'low' AS severity", "0 AS sev_rank", "CAST(NULL AS STRING) AS cwe_id", "'d' AS description", "CAST(NULL AS STRING) AS scope",
    )
    files = as_files(spark.range(200).selectExpr("concat('f', id, '.py') AS path", "concat('call_', id, '()\nnothing of the kind ', id, '\nx = ', id) AS code"))
    joined, real = [], rule_tables.join_lookup

    def counted(left, lookup, keys, *args, **options):
        if keys == ["key"]:
            joined.append(left.count())
        return real(left, lookup, keys, *args, **options)

    monkeypatch.setattr(rule_tables, "join_lookup", counted)
    monkeypatch.setattr(rule_tables, "FEW", 100)
    got = table_hits(files, prepared(rules), max_bytes=0).select("path", "line_no", "rule_id")
    assert sorted(map(tuple, got.collect())) == sorted((f"f{i}.py", n, f"R{i}") for i in range(200) for n in (1, 3))
    assert joined and sum(joined) < 3000


def test_places_of_rarest_pieces_and_their_halves():
    texts, counts = pa.array(["user_id = 1", "xx", "order = 12345"]), np.zeros(P.SLOTS, np.int64)
    (_, common), = P.pieces(pa.array(["user_id "]), [8])
    counts[((common >> np.uint64(8)) % np.uint64(P.SLOTS)).astype(np.int64)] = 9
    found = P.rarest(texts.take(pa.array([0, 2])), pa.array([8, 12]), counts)
    assert found.field("at").to_pylist() == [1, 0]
    for text, size, row in ((b"ser_id =", 8, 0), (b"order = 1234", 12, 1)):
        assert P._windows(np.frombuffer(text, np.uint8), size).view(np.int64).tolist() == [found.field("key")[row].as_py()]
    halves = P.half_keys(pa.array(["user_id = 1", "order = 12345"]), pa.array([8, 12]), found.field("at")).to_pylist()
    of = lambda text: int(P._windows(np.frombuffer(text, np.uint8), len(text))[0])
    want = {of(b"ser_"), of(b"id =") ^ int(P._SECOND), of(b"order "), of(b"= 1234") ^ int(P._SECOND)}
    assert {h % (1 << 64) for h in halves} == want


def test_more_keys_than_a_filter_tells_apart(spark, monkeypatch):
    """Where rules were more than the filter's bits, a fifth of all pieces of all lines travelled."""
    rules = spark.range(300).selectExpr(
        "concat('R', id) AS rule_id", "'sast' AS engine", "CAST(id AS INT) AS ord", "'t' AS title", "concat('call_', 1000 + id, '[(]now', '|zq', id % 9, '~#$') AS pattern",
        "'low' AS severity", "0 AS sev_rank", "CAST(NULL AS STRING) AS cwe_id", "'d' AS description", "CAST(NULL AS STRING) AS scope",
    ).unionAll(spark.range(300).selectExpr(
        "concat('S', id)", "'sast'", "CAST(id AS INT)", "'t'", "concat('order number ', 1000 + id, ';')", "'low'", "0", "CAST(NULL AS STRING)", "'d'", "CAST(NULL AS STRING)",
    ))
    noise = "lpad(conv(CAST(pmod(xxhash64(id, {}), 1000000007) AS STRING), 10, 36), 40, 'the quick brown fox jumps over lazy dogs')"
    files = as_files(spark.range(300).selectExpr("concat('f', id, '.py') AS path", f"concat('call_', 1000 + id, '(now)\n', {noise.format(1)}, '\n', {noise.format(2)}, '\norder number ', 1000 + id, ';') AS code"))
    joined, real = [], rule_tables.join_lookup

    def counted(left, lookup, keys, *args, **options):
        if keys == ["key"]:
            joined.append(left.count())
        return real(left, lookup, keys, *args, **options)

    monkeypatch.setattr(rule_tables, "join_lookup", counted)
    monkeypatch.setattr(P, "MOST_BITS", 11)
    monkeypatch.setattr(P, "LEAST_BITS", 11)
    got = table_hits(files, prepared(rules), max_bytes=0).select("path", "line_no", "rule_id")
    assert sorted(map(tuple, got.collect())) == sorted([(f"f{i}.py", 1, f"R{i}") for i in range(300)] + [(f"f{i}.py", 4, f"S{i}") for i in range(300)])
    assert joined and sum(joined) < 6000


def test_rules_of_few_pieces_meet_lines_without_a_shuffle(spark, monkeypatch):
    """Lines with short frequent pieces were shuffled by rule, all lines of a rule to one task."""
    rules = spark.range(400).selectExpr(
        "concat('R', id) AS rule_id", "'sast' AS engine", "CAST(id AS INT) AS ord", "'t' AS title", "CASE WHEN id < 2 THEN concat('=', id, '!') ELSE concat('call number ', id, '[(]') END AS pattern",
        "'low' AS severity", "0 AS sev_rank", "CAST(NULL AS STRING) AS cwe_id", "'d' AS description", "CAST(NULL AS STRING) AS scope",
    )
    files = as_files(spark.range(100).selectExpr("concat('f', id, '.py') AS path", "concat('x=', id % 2, '!\ncall number ', id, '()') AS code"))
    met, real = [], rule_tables._met

    def counted(texts, rules, max_bytes):
        met.append(rules.count())
        return real(texts, rules, max_bytes)

    monkeypatch.setattr(rule_tables, "_met", counted)
    monkeypatch.setattr(rule_tables, "FEW", 50)
    got = table_hits(files, prepared(rules), max_bytes=0).select("path", "line_no", "rule_id")
    assert sorted(map(tuple, got.collect())) == sorted([(f"f{i}.py", 1, f"R{i % 2}") for i in range(100)] + [(f"f{i}.py", 2, f"R{i}") for i in range(2, 100)])
    assert sorted(met) == [2, 400]
