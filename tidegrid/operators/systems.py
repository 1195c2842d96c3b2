"""Checks of known transmission systems on bits: code words, characters of constant weight, headers; as expressions over arrays of bits."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes

#: The generator of the paging code's check bits.
BCH = 0b11101101001
#: Letters of the four-of-seven alphabet by their group; controls in brackets.
LETTERS = {0x47: "A", 0x72: "B", 0x1D: "C", 0x53: "D", 0x56: "E", 0x1B: "F", 0x35: "G", 0x69: "H", 0x4D: "I", 0x17: "J", 0x1E: "K", 0x65: "L", 0x39: "M", 0x59: "N", 0x71: "O", 0x2D: "P", 0x2E: "Q", 0x55: "R", 0x4B: "S", 0x74: "T", 0x4E: "U", 0x3C: "V", 0x27: "W", 0x3A: "X", 0x2B: "Y", 0x63: "Z", 0x5C: " ", 0x78: "\r", 0x6C: "\n"}
#: The same groups after the shift to figures.
FIGURES = {0x47: "-", 0x72: "?", 0x1D: ":", 0x56: "3", 0x1B: "!", 0x35: "&", 0x4D: "8", 0x1E: "(", 0x65: ")", 0x39: ".", 0x59: ",", 0x71: "9", 0x2D: "0", 0x2E: "1", 0x55: "4", 0x4B: "'", 0x74: "5", 0x4E: "7", 0x3C: "=", 0x27: "2", 0x3A: "/", 0x2B: "6", 0x63: "+", 0x5C: " ", 0x78: "\r", 0x6C: "\n", 0x69: "£"}
TO_LETTERS, TO_FIGURES = 0x5A, 0x36


def page_word(word: Column) -> tuple[Column, Column]:
    """The remainder of a 32-bit word's 31 code bits and the parity of all; both 0 on code words."""
    return codes.poly_mod(F.shiftright(word, 1), BCH, 30), F.bit_count(word) % 2


def page_word_of(data: Column) -> Column:
    """The code word of 21 data bits: data, check bits, parity."""
    body = F.transform(F.array(data), lambda x: F.shiftleft(x, 10).bitwiseOR(codes.poly_mod(F.shiftleft(x, 10), BCH, 30)))
    return F.get(F.transform(body, lambda x: F.shiftleft(x, 1).bitwiseOR((F.bit_count(x) % 2).cast("long"))), 0)


def page_fields(word: Column, slot: Column) -> dict[str, Column]:
    """What an address word says: the address with the frame it stands in, and the function."""
    return {"address": F.shiftleft(F.shiftright(word, 13).bitwiseAND(F.lit(0x3FFFF)), 3).bitwiseOR(F.floor(slot / 2).cast("long")), "function": F.shiftright(word, 11).bitwiseAND(F.lit(3))}


def groups(bits: Column, width: int, offset: int = 0) -> Column:
    """Whole groups of so many bits from an offset, the first bit highest."""
    n = F.floor((F.size(bits) - offset) / width).cast("int")
    one = lambda k: F.aggregate(F.slice(bits, k * width + offset + 1, width), F.lit(0), lambda a, b: a * 2 + b)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))


def repeated_groups(g: Column, lag: int = 5, ones: int = 4) -> tuple[Column, Column]:
    """Valid groups, and groups equal to the one so many places before, both valid and no run of one character."""
    valid = lambda x: F.bit_count(x) == ones
    at = F.when(F.size(g) > lag, F.sequence(F.lit(lag), F.size(g) - 1)).otherwise(F.array().cast("array<int>"))
    agree = F.filter(at, lambda k: valid(F.get(g, k)) & (F.get(g, k) == F.get(g, k - lag)) & (F.get(g, k) != F.get(g, k - 1)))
    return F.size(F.filter(g, valid)), F.size(agree)


def teletype(g: Column) -> Column:
    """The text of an array of groups, in letters until a shift; groups that are no character read '?', controls nothing."""
    tables = [F.create_map(*(F.lit(x) for pair in t.items() for x in pair)) for t in (LETTERS, FIGURES)]
    start = F.struct(F.lit(0).alias("shift"), F.lit("").alias("text"))

    def step(a, x):
        known = F.when(a["shift"] == 1, F.try_element_at(tables[1], x)).otherwise(F.try_element_at(tables[0], x))
        char = F.when(F.bit_count(x) != 4, "?").otherwise(F.coalesce(known, F.lit("")))
        return F.struct(F.when(x == TO_FIGURES, 1).when(x == TO_LETTERS, 0).otherwise(a["shift"]).alias("shift"), F.concat(a["text"], char).alias("text"))

    return F.aggregate(g, start, step, lambda a: a["text"])


def checked_symbols(bits: Column) -> tuple[Column, Column]:
    """Ten-bit characters: the seven bits, lowest first, as numbers, and whether the three check bits count their zeros."""
    g = groups(bits, 10)
    value = lambda x: F.reverse(F.lpad(F.conv(F.shiftright(x, 3), 10, 2), 7, "0"))
    symbols = F.transform(g, lambda x: F.conv(value(x), 2, 10).cast("int"))
    good = F.transform(g, lambda x: x.bitwiseAND(F.lit(7)) == 7 - F.bit_count(F.shiftright(x, 3)))
    return symbols, good


def transfer_frame_header(bits: Column) -> dict[str, Column]:
    """The fields of a primary header of 48 bits."""
    parts = (("version", 0, 2), ("spacecraft", 2, 10), ("channel", 12, 3), ("control_flag", 15, 1), ("master_count", 16, 8), ("channel_count", 24, 8), ("status", 32, 16))
    return {name: codes.packed(bits, at, n) for name, at, n in parts}
