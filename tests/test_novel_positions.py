"""The query novel_board_positions against plain sets."""

import pytest

from plyforge.operators import board as boards
from plyforge.operators import sampling
from plyforge.operators.board import Board, novel_plies
from plyforge.plans import catalog, jobs
from tests.conftest import SF


def positions(text):
    board, out = Board(), []
    for san in text.split():
        if not board.push(san):
            break
        out.append(" ".join(board.fen().split()[:-2]))
    return out


def novel(games, train, test):
    known = {f for g in train for f in positions(games[g])}
    plies = {g: [i for i, f in enumerate(positions(games[g])) if f not in known] for g in test}
    return {(g, len(p), tuple(p)) for g, p in plies.items() if p}


def test_every_game_is_train_or_test(spark, monkeypatch):
    sides = []
    monkeypatch.setattr(catalog.board, "novel_plies", lambda g, train, test, game, **kw: sides.extend((g, train, test)) or spark.createDataFrame([], "o_orderkey long, n long, plies array<int>"))
    catalog.QUERIES["novel_board_positions"](spark, SF)
    games, train, test = ([r.o_orderkey for r in s.select("o_orderkey").collect()] for s in sides)
    assert sorted(train + test) == sorted(games) and 0 < len(test) < len(train)


def test_positions_after_the_moves(spark):
    """The position after a game's last move is known from train games and looked up for test games."""
    games = {1: "e4 e5 Nf3", 2: "e4 e5 Nc3 Nc6", 3: "e4 e5 Nf3 Nf6", 4: "e4 e5 Nf3", 5: "e4 e5 Nh3", 6: "d4 d5 Ke3", 7: "e4 Ke3", 8: ""}
    frame = spark.createDataFrame(list(games.items()), "game_id long, moves string")
    ids = lambda *g: spark.createDataFrame([(x,) for x in g], "game_id long")
    got = {(r.game_id, r.n, tuple(r.plies)) for r in novel_plies(frame, ids(1), ids(2, 3, 4, 5, 6, 7, 8), after=True).collect()}
    assert got == novel(games, [1], [2, 3, 4, 5, 6, 7, 8]) == {(2, 2, (2, 3)), (3, 1, (3,)), (5, 1, (2,)), (6, 2, (0, 1))}


@pytest.mark.parametrize("after", [True, False])
@pytest.mark.parametrize("flush", [1, 3, 1 << 16])
@pytest.mark.parametrize("told", ["game_id", "*"])
def test_sides_by_id_or_with_moves(spark, monkeypatch, told, flush, after):
    """Transpositions, equal texts, a game on both sides, games of no move and of no text; whatever a task holds at once."""
    games = {1: "e4 e5 Nf3 Nc6", 2: "Nf3 Nc6 e4 e5 Bb5", 3: "e4 e5 Nf3 Nc6 Bc4", 4: "e4 e5 Nf3 Nc6 Bc4", 5: "Nf3 Nf6 Ng1 Ng8 Nf3 Ke3", 6: "Ke3", 7: "", 8: None, 9: "d4 d5", 10: "d4 d5 c4 Ke3"}
    train, test = [1, 6, 8, 9], [2, 3, 4, 5, 6, 7, 8, 9, 10]
    monkeypatch.setattr(boards, "FLUSH", flush)
    frame = spark.createDataFrame(list(games.items()), "game_id long, moves string").coalesce(1)
    side = lambda ids: frame.where(frame.game_id.isin(ids)).select(told)
    got = {(r.game_id, r.n, tuple(r.plies)) for r in novel_plies(frame, side(train), side(test), after=after).collect()}
    if after:
        assert got == novel({g: text or "" for g, text in games.items()}, train, test)
    else:
        assert got == {(2, 4, (1, 2, 3, 4)), (3, 1, (4,)), (4, 1, (4,)), (5, 4, (1, 2, 3, 5)), (10, 2, (2, 3))}


def shuffled(spark, after):
    """(last stage, records that the stages after the one given have shuffled)."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    stages = [found.apply(i) for i in range(found.size())]
    return max((s.stageId() for s in stages), default=-1), sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after)


def test_plies_are_not_shuffled_one_by_one(spark):
    """A task's memory is not that of all plies: shared positions travel once a batch, and novel plies without theirs."""
    n, text = 4000, catalog.OPENINGS[0]
    frame = spark.createDataFrame([(g, text + " h3" * (g % 2)) for g in range(n)], "game_id long, moves string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last, _ = shuffled(spark, -1)
        rows = novel_plies(frame, frame.where("game_id % 2 = 0"), frame.where("game_id % 2 = 1"), after=True).collect()
        _, records = shuffled(spark, last)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert {(r.n, tuple(r.plies)) for r in rows} == {(1, (len(text.split()),))} and len(rows) == n // 2
    assert n // 2 <= records < 2 * n  # of 16 and 17 plies a game


def test_query_equals_plain_sets(spark):
    games = {r.o_orderkey: r.moves for r in catalog.openings(spark, SF).collect()}
    want = novel(games, [g for g in games if g % 10 != 1], [g for g in games if g % 10 == 1])
    got = {(r.o_orderkey, r.n, r.plies) for r in catalog.QUERIES["novel_board_positions"](spark, SF).collect()}
    assert got == {(g, n, ",".join(map(str, p))) for g, n, p in want}


def test_games_are_long_and_legal_to_their_last_moves(spark):
    for text in catalog.OPENINGS:
        assert len(positions(text)) == len(text.split()) >= 10
    rows = catalog.QUERIES["replay_plies"](spark, SF).collect()
    games = {r.o_orderkey: r.moves.split() for r in catalog.openings(spark, SF).collect()}
    assert sum(r.legal for r in rows) / len(games) > 8 and {r.san for r in rows} >= {"O-O", "O-O-O", "exd6", "bxa8=Q", "Bb4+"}
    for r in rows:
        board = Board()
        assert all(board.push(m) for m in games[r.o_orderkey][: r.ply])
        assert r.fen == " ".join(board.fen().split()[:-2]) and r.san == games[r.o_orderkey][r.ply] and r.legal == board.push(r.san)


def test_sampled_positions_equal_a_plain_draw(spark):
    """The query skew_board_positions: one draw a game, the first ply at which the summed weights pass it, four plies from there."""
    import hashlib

    want = set()
    for r in catalog.openings(spark, SF).collect():
        board, fens = Board(), []
        for san in r.moves.split():
            fen = " ".join(board.fen().split()[:-2])
            if not board.push(san):
                break
            fens.append(fen)
        n = len(fens)
        draw = int(hashlib.md5(f"7|{r.o_orderkey}".encode()).hexdigest()[:8], 16) / 2**32
        least, mass, first = 1 / (4 * (n + 1)), 0.0, None
        for i in range(n):
            mass += least + 2 * i / n * (1 / (n + 1) - least)
            if first is None and draw < mass:
                first = i
        if first is not None:
            want |= {(r.o_orderkey, i, fens[i], i - first) for i in range(first, min(n, first + 4))}
    got = {(r.o_orderkey, r.ply, r.fen, r.k) for r in catalog.QUERIES["skew_board_positions"](spark, SF).collect()}
    assert got == want and len({g for g, *_ in got}) > 50


@pytest.mark.parametrize(("most", "seed", "skew"), [(4, 7, 4), (1, 1, 2), (50, 3, 1)])
def test_sampled_positions_without_a_shuffle(spark, most, seed, skew):
    """The rows that skewed_prefix takes of all plies, though no ply leaves the task that replays its game."""
    games = spark.createDataFrame([(g, text) for g, text in enumerate([*catalog.OPENINGS * 30, "Ke3", "", None, "e4 Ke3", "e4"])], "game_id long, moves string")
    last, _ = shuffled(spark, -1)
    got = jobs.sampled_positions(games, "game_id", most, seed, skew)
    rows = got.collect()
    assert shuffled(spark, last)[1] == 0
    want = sampling.skewed_prefix(boards.replayed(games).where("legal").select("game_id", "ply", "fen"), "game_id", ["ply"], most, seed, skew)
    assert got.dtypes == want.dtypes and len(rows) > 100 and sorted(rows) == sorted(want.collect())
