"""Texts that operators must not stumble over."""

from __future__ import annotations


def long_text(n: int = 60_000) -> str:
    return " ".join(f"w{k * k % 7919}" for k in range(n))


#: Texts that are null, empty, blank, very long, equal, equal but for blanks and case, and short, under ids that are null or negative.
ODD = [
    (1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, long_text()), (5, "a b c d e f g h"), (6, "a b c d e f g h"), (7, "A  b\tc d e f g h "),
    (8, "é ß ☃ 😀 \x00 x y"), (-9, "one two"), (10, "one two"), (11, "released under the MIT license; apache-license version 2. cc by-nc"), (12, " ".join(["again"] * 200)),
    (13, "a <|endoftext|> b İ- Aİ! İ. ΑΣ"),
]
