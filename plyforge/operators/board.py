"""Replaying move texts: positions, legality and position keys for every ply of a game.

The board is a list of 64 squares from a1 to h8. Moves are read in standard algebraic notation; a move is resolved to the
one piece that can make it without leaving its king in check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.operators import sequences

SAN = re.compile(r"(?:([RNBQK])?([a-h])?([1-8])?x?([a-h])([1-8])(?:=?([RNBQ]))?|(O-O-O|O-O|0-0-0|0-0))[+#]?[!?]*$")
STRAIGHT = [(0, 1), (0, -1), (1, 0), (-1, 0)]
SLANTED = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
LEAPS = [(1, 2), (2, 1), (-1, 2), (-2, 1), (1, -2), (2, -1), (-1, -2), (-2, -1)]
START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
#: Positions that a task holds before it gives them on.
FLUSH = 1 << 16


class Board:
    """A position: squares (None or a piece letter, capitals for white), side to move, castling rights, en passant."""

    def __init__(self, fen: str = START) -> None:
        rows, turn, castling, target, half, full = (fen.split() + ["w", "-", "-", "0", "1"])[:6]
        self.at: list[str | None] = []
        for row in reversed(rows.split("/")):
            for c in row:
                self.at += [None] * int(c) if c.isdigit() else [c]
        self.white = turn == "w"
        self.castling = set(castling) - {"-"}
        self.target = None if target == "-" else ord(target[0]) - 97 + 8 * (int(target[1]) - 1)
        self.half, self.full = int(half), int(full)

    def copy(self) -> Board:
        out = Board.__new__(Board)
        out.__dict__ = self.__dict__ | {"at": self.at[:], "castling": set(self.castling)}
        return out

    def fen(self) -> str:
        rows = []
        for r in range(7, -1, -1):
            row, gap = "", 0
            for p in self.at[8 * r : 8 * r + 8]:
                if p is None:
                    gap += 1
                else:
                    row += (str(gap) if gap else "") + p
                    gap = 0
            rows.append(row + (str(gap) if gap else ""))
        target = "-" if self.target is None or not self._can_take(self.target) else "abcdefgh"[self.target % 8] + str(self.target // 8 + 1)
        castling = "".join(c for c in "KQkq" if c in self.castling) or "-"
        return f"{'/'.join(rows)} {'w' if self.white else 'b'} {castling} {target} {self.half} {self.full}"

    def _can_take(self, target: int) -> bool:
        """Whether a pawn of the side to move can take en passant at target without exposing its king."""
        back = -1 if self.white else 1
        pawn = "P" if self.white else "p"
        for df in (-1, 1):
            f, r = target % 8 + df, target // 8 + back
            if 0 <= f < 8 and self.at[8 * r + f] == pawn and self._safe_after(8 * r + f, target):
                return True
        return False

    def attacked(self, square: int, by_white: bool) -> bool:
        f, r = square % 8, square // 8
        mine = (lambda p: p.isupper()) if by_white else (lambda p: p.islower())
        for steps, kinds, far in ((STRAIGHT, "RQ", True), (SLANTED, "BQ", True), (LEAPS, "N", False), (STRAIGHT + SLANTED, "K", False)):
            for df, dr in steps:
                x, y = f + df, r + dr
                while 0 <= x < 8 and 0 <= y < 8:
                    p = self.at[8 * y + x]
                    if p:
                        if mine(p) and p.upper() in kinds:
                            return True
                        break
                    if not far:
                        break
                    x, y = x + df, y + dr
        dr = -1 if by_white else 1
        return any(0 <= f + df < 8 and 0 <= r + dr < 8 and self.at[8 * (r + dr) + f + df] == ("P" if by_white else "p") for df in (-1, 1))

    def _reaches(self, piece: str, a: int, b: int) -> bool:
        df, dr = b % 8 - a % 8, b // 8 - a // 8
        kind = piece.upper()
        if kind == "N":
            return (df, dr) in LEAPS
        if kind == "K":
            return max(abs(df), abs(dr)) == 1
        if kind == "P":
            up = 1 if piece == "P" else -1
            if df == 0:
                two = dr == 2 * up and a // 8 == (1 if up == 1 else 6) and self.at[a + 8 * up] is None
                return (dr == up or two) and self.at[b] is None
            return abs(df) == 1 and dr == up and (self.at[b] is not None or b == self.target)
        if not (df == 0 or dr == 0) if kind == "R" else abs(df) != abs(dr) if kind == "B" else not (df == 0 or dr == 0 or abs(df) == abs(dr)):
            return False
        sf, sr = (df > 0) - (df < 0), (dr > 0) - (dr < 0)
        x = a + sf + 8 * sr
        while x != b:
            if self.at[x] is not None:
                return False
            x += sf + 8 * sr
        return True

    def _safe_after(self, a: int, b: int) -> bool:
        held, taken = list(self.at), self.at[a]
        if taken and taken.upper() == "P" and b == self.target and self.at[b] is None:
            self.at[b + (-8 if self.white else 8)] = None
        self.at[b], self.at[a] = taken, None
        king = "K" if self.white else "k"
        safe = king not in self.at or not self.attacked(self.at.index(king), not self.white)
        self.at = held
        return safe

    def push(self, san: str) -> bool:
        """Makes a move; False, and no change, if it is unreadable, ambiguous or illegal."""
        m = SAN.match(san)
        if not m:
            return False
        if m[7]:
            return self._castle(len(m[7]) == 3)
        kind, to = m[1] or "P", ord(m[4]) - 97 + 8 * (int(m[5]) - 1)
        piece = kind if self.white else kind.lower()
        if self.at[to] is not None and self.at[to].isupper() == self.white:
            return False
        if kind == "P" and (to // 8 in (0, 7)) != bool(m[6]) or kind != "P" and m[6]:
            return False
        found = [
            a for a, p in enumerate(self.at)
            if p == piece and (not m[2] or a % 8 == ord(m[2]) - 97) and (not m[3] or a // 8 == int(m[3]) - 1) and a != to and self._reaches(piece, a, to) and self._safe_after(a, to)
        ]
        if len(found) != 1:
            return False
        a = found[0]
        taken = self.at[to] is not None
        if kind == "P" and to == self.target and not taken:
            self.at[to + (-8 if self.white else 8)] = None
            taken = True
        self.at[to], self.at[a] = (m[6] if self.white else m[6].lower()) if m[6] else piece, None
        self.target = (a + to) // 2 if kind == "P" and abs(a - to) == 16 else None
        lost = {4: "KQ", 60: "kq", 0: "Q", 7: "K", 56: "q", 63: "k"}
        self.castling -= set(lost.get(a, "")) | set(lost.get(to, ""))
        self._turn(kind == "P" or taken)
        return True

    def _castle(self, short: bool) -> bool:
        home = 0 if self.white else 56
        right = ("K" if short else "Q") if self.white else ("k" if short else "q")
        between = [home + x for x in ((5, 6) if short else (1, 2, 3))]
        path = [home + x for x in ((4, 5, 6) if short else (4, 3, 2))]
        if right not in self.castling or any(self.at[x] for x in between) or any(self.attacked(x, not self.white) for x in path):
            return False
        rook = home + (7 if short else 0)
        self.at[path[2]], self.at[path[1]] = self.at[home + 4], self.at[rook]
        self.at[home + 4] = self.at[rook] = None
        self.castling -= set("KQ" if self.white else "kq")
        self.target = None
        self._turn(False)
        return True

    def _turn(self, reset: bool) -> None:
        self.half = 0 if reset else self.half + 1
        self.full += not self.white
        self.white = not self.white


class Line:
    """The moves of one game, each with the position before and after it, kept as far as the next game has the same."""

    def __init__(self) -> None:
        self.boards, self.fens = [Board()], [_trimmed(Board())]
        self.made: list[tuple[str, str, str | None, bool]] = []

    def through(self, moves: list[str]) -> list[tuple[str, str, str | None, bool]]:
        """(move, position before, position after, legal) of each of moves up to the first that can't be made."""
        same = 0
        while same < min(len(moves), len(self.made)) and moves[same] == self.made[same][0]:
            same += 1
        del self.made[same:], self.boards[same + 1 :], self.fens[same + 1 :]
        for san in moves[same:] if not self.made or self.made[-1][3] else ():
            board = self.boards[-1].copy()
            legal = board.push(san)
            self.made.append((san, self.fens[-1], _trimmed(board) if legal else None, legal))
            if not legal:
                break
            self.boards.append(board)
            self.fens.append(self.made[-1][2])
        return self.made


def _trimmed(board: Board) -> str:
    return board.fen().rsplit(" ", 2)[0]


def replayed(games: DataFrame, game: str = "game_id", moves: str = "moves", limit: int | None = None, after: bool = False) -> DataFrame:
    """(game, ply, san, fen, legal): for each move of a game the position before it, without the move counters.

    after: the position after it instead, null for a move that can't be made. The first move that can't be made has
    legal false and ends its game. limit: only the first plies. The key column must be a long. A null move text has no
    plies.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            line = Line()
            # In the order of their texts, games begin as the one before: those moves aren't made again.
            for g, text in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=lambda x: x[1] or ""):
                for ply, (san, before, next_, legal) in enumerate(line.through((text or "").split()[:limit])):
                    out.append((g, ply, san, next_ if after else before, legal))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [game, "ply", "san", "fen", "legal"])

    return games.select(F.col(game).cast("long").alias(game), moves).mapInArrow(rows, f"{game} long, ply long, san string, fen string, legal boolean")


def lines(games: DataFrame, game: str = "game_id", moves: str = "moves") -> DataFrame:
    """(game, fens): for each game, with a text or not, the positions before its legal moves, in their order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda ids, fens: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fens, pa.list_(pa.string()))], [game, "fens"])
        for batch in batches:
            line, ids, fens, held = Line(), [], [], 0
            for g, text in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=lambda x: x[1] or ""):
                ids.append(g)
                fens.append([before for _, before, _, legal in line.through((text or "").split()) if legal])
                held += len(fens[-1])
                if held >= FLUSH:
                    yield give(ids, fens)
                    ids, fens, held = [], [], 0
            yield give(ids, fens)

    return games.select(F.col(game).cast("long").alias(game), moves).mapInArrow(rows, f"{game} long, fens array<string>")


def _fen_rows(line: Line, text: str | None, after: bool) -> Iterator[tuple[int, str]]:
    """(ply, position) of a move text's plies, where there is one."""
    for ply, (_, before, next_, _) in enumerate(line.through((text or "").split())):
        if fen := next_ if after else before:
            yield ply, fen


def reached(games: DataFrame, moves: str = "moves", after: bool = False) -> DataFrame:
    """(fen): the positions of replayed, each once for a batch of games or for FLUSH positions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda fens: pa.RecordBatch.from_arrays([pa.array(fens, pa.string())], ["fen"])
        for batch in batches:
            line, fens = Line(), set()
            for text in sorted(set(batch.column(0).to_pylist()) - {None}):
                fens.update(fen for _, fen in _fen_rows(line, text, after))
                if len(fens) >= FLUSH:
                    yield give(list(fens))
                    fens.clear()
            yield give(list(fens))

    return games.select(moves).mapInArrow(rows, "fen string")


def placed(games: DataFrame, game: str = "game_id", moves: str = "moves", after: bool = False) -> DataFrame:
    """(fen, ply, games): the plies of replayed that have a position; games of a batch with the same one at a ply share a row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(found: dict[tuple[int, str], list[int]]) -> pa.RecordBatch:
            plies, fens = list(zip(*found)) or [(), ()]
            cols = [pa.array(fens, pa.string()), pa.array(plies, pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["fen", "ply", "games"])

        for batch in batches:
            line, found = Line(), {}
            for g, text in sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), key=lambda x: x[1] or ""):
                for at in _fen_rows(line, text, after):
                    found.setdefault(at, []).append(g)
                if len(found) >= FLUSH:
                    yield give(found)
                    found.clear()
            yield give(found)

    return games.select(F.col(game).cast("long").alias(game), moves).mapInArrow(rows, "fen string, ply long, games array<long>")


def novel_plies(games: DataFrame, train: DataFrame, test: DataFrame, game: str = "game_id", after: bool = False) -> DataFrame:
    """(game, n, plies) of the test games: their plies whose position no train game has, for games with any.

    train and test: games with their moves, or else ids, whose moves are looked up in games. after: the positions that
    legal moves lead to, so that a game's last one counts; else those that moves start from. What is shuffled is the
    train games' positions, each once a task, and the test games' with the lists of games that share them.
    """
    train, test = (side if "moves" in side.columns else games.join(side.select(game), game, "left_semi") for side in (train, test))
    # Merged: the estimates, from the move texts, are far below what the positions hold, too low to broadcast by.
    new = sequences.novel(placed(test, game, after=after).hint("merge"), "fen", reached(train, after=after))
    return new.select(F.explode("games").alias(game), "ply").groupBy(game).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("ply")).alias("plies"))
