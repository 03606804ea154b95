"""Column expressions for game records: header tokens, move tokens, clocks and positions in text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds and names of header tokens, and how a move text is cut.
RATING_EDGES = list(range(1000, 3001, 200))
TIME_EDGES = [(60, "1MINUTE"), (180, "3MINUTES"), (300, "5MINUTES"), (600, "10MINUTES"), (900, "15MINUTES"), (1800, "30MINUTES"), (3600, "1HOUR")]
INCREMENT_EDGES = [(5, "5SECONDS"), (10, "10SECONDS"), (15, "15SECONDS")]
MOVE_PATTERN = r"O-O-O|O-O|[RNBQK]|[a-h][0-9]|[0-9]|[RNBQKa-h]|[x=+#]|\s"
MOVE_GROUP_PATTERN = r"O-O-O|O-O|[RNBQK]|[a-h][0-9]|[a-h]|[RNBQKa-h]|[x=+#]|\s"
NOOP = 103


#: Header and outcome tokens in the order of their ids, from NOOP on.
SPECIAL = [
    "<|NOOP|>", "<|WHITEWINS|>", "<|BLACKWINS|>", "<|DRAW|>",
    "<|ELO1000|>", "<|ELO1200|>", "<|ELO1400|>", "<|ELO1600|>", "<|ELO1800|>", "<|ELO2000|>", "<|ELO2200|>", "<|ELO2400|>", "<|ELO2600|>", "<|ELO2800|>", "<|ELO3000|>",
    "<|ELOMAX|>", "<|ELOUNKNOWN|>",
    "<|3HOURS|>", "<|1HOUR|>", "<|30MINUTES|>", "<|15MINUTES|>", "<|10MINUTES|>", "<|5MINUTES|>", "<|3MINUTES|>", "<|1MINUTE|>",
    "<|0SECONDS|>", "<|1SECOND|>", "<|5SECONDS|>", "<|10SECONDS|>", "<|15SECONDS|>", "<|30SECONDS|>", "<|MAXSECONDS|>",
]


def vocabulary(max_id: int | None = None) -> dict[str, int]:
    """Move tokens and their ids, built by rule: castling, pieces, files, digits, signs, squares by rank, the space.

    max_id: only ids up to it.
    """
    names = ["O-O-O", "O-O", *"RNBQK", *"abcdefgh", *"0123456789", *"x=#+"]
    names += [f + r for r in "12345678" for f in "abcdefgh"] + [" "]
    return {t: i for i, t in enumerate(names) if max_id is None or i <= max_id}


def special_tokens() -> dict[str, int]:
    """Header and outcome tokens, numbered from NOOP on."""
    return {name: NOOP + i for i, name in enumerate(SPECIAL)}


def _upto(value: Column, edges: list[tuple[int, str]], rest: Column) -> Column:
    out = rest
    for edge, name in reversed(edges):
        out = F.when(value <= edge, F.lit(f"<|{name}|>")).otherwise(out)
    return out


def rating_token(rating: Column, max_group: int = 3000) -> Column:
    """The band of a rating, bounds included above; ELOMAX over max_group or the last bound, null for null."""
    band = _upto(rating, [(e, f"ELO{e}") for e in RATING_EDGES], F.lit("<|ELOMAX|>"))
    return F.when(rating.isNull(), None).when(rating > max_group, F.lit("<|ELOMAX|>")).otherwise(band)


def time_token(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), _upto(seconds, TIME_EDGES, F.lit("<|3HOURS|>")))


def increment_token(seconds: Column) -> Column:
    rest = F.when(seconds == 30, F.lit("<|30SECONDS|>")).otherwise(F.lit("<|MAXSECONDS|>"))
    out = F.when(seconds == 0, F.lit("<|0SECONDS|>")).when(seconds == 1, F.lit("<|1SECOND|>")).otherwise(_upto(seconds, INCREMENT_EDGES, rest))
    return F.when(seconds.isNotNull(), out)


def outcome(result: Column) -> Column:
    """1, -1 or 0 for the result codes 0, 1 and 2; any other is an error, null stays null."""
    known = F.when(result == 0, 1).when(result == 1, -1).when(result == 2, 0)
    return F.when(result.isNull(), None).when(result.isin(0, 1, 2), known).otherwise(F.raise_error(F.concat(F.lit("no such result: "), result.cast("string"))))


def game_text(white: Column, black: Column, time: Column, increment: Column, moves: Column) -> Column:
    """Header tokens and moves, joined by single spaces."""
    return F.concat_ws(" ", white, black, time, increment, F.array_join(F.filter(F.split(moves, r"\s+"), lambda m: m != ""), " "))


def move_pieces(text: Column, pattern: str = MOVE_PATTERN) -> Column:
    """The vocabulary's pieces of a move text; characters that fit nothing are dropped."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def move_ids(text: Column) -> Column:
    """Token ids of a move text; a piece that isn't in the vocabulary (a9) gives the ids of its characters."""
    ids = F.create_map(*(x for t, i in vocabulary().items() for x in (F.lit(t), F.lit(i))))
    known = lambda p: F.element_at(ids, F.when(p.rlike(r"^\s$"), F.lit(" ")).otherwise(p))
    parts = F.transform(move_pieces(text), lambda p: F.when(known(p).isNotNull(), F.array(known(p))).otherwise(F.transform(F.split(p, ""), known)))
    return F.filter(F.flatten(parts), lambda i: i.isNotNull())


def move_groups(moves: Column) -> Column:
    """For each word of a move text the array of its pieces, without disambiguating digits."""
    words = F.filter(F.split(moves, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: move_pieces(w, MOVE_GROUP_PATTERN))


def clock_digits(seconds: Column) -> Column:
    """Place values of a number in digits: 180 gives 100 and 80, 105 gives 100, 0, 5; zeros at the end give nothing."""
    digits = seconds.cast("string")
    kept = F.rtrim(digits, F.lit("0"))
    places = F.sequence(F.lit(1), F.length(kept))
    value = lambda i: F.concat(F.substr(kept, i, F.lit(1)), F.when(F.substr(kept, i, F.lit(1)) != "0", F.repeat(F.lit("0"), F.length(digits) - i)).otherwise(F.lit("")))
    return F.when(F.length(kept) > 0, F.transform(places, value)).otherwise(F.array().cast("array<string>"))


def interleaved(clocks: Column, moves: Column) -> Column:
    """For every ply its clock's place values, then its move's pieces; plies that have only one of them keep it."""
    clock_words = F.transform(F.filter(F.split(clocks, r"\s+"), lambda w: w != ""), clock_digits)
    pairs = F.arrays_zip(clock_words.alias("c"), move_groups(moves).alias("m"))
    empty = F.array().cast("array<string>")
    return F.flatten(F.transform(pairs, lambda p: F.concat(F.coalesce(p["c"], empty), F.coalesce(p["m"], empty))))


def fen_trimmed(fen: Column) -> Column:
    """A FEN without its half-move and move counters."""
    parts = F.split(fen, " ")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), " ")


def fen_board(fen: Column) -> Column:
    """The board field of a FEN without slashes."""
    return F.replace(F.element_at(F.split(fen, " "), 1), F.lit("/"), F.lit(""))
