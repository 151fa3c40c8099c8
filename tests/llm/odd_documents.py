"""Documents with nulls, empty and very long texts, copies, ties and clashing columns."""

from __future__ import annotations

import random

#: Names that the operators use inside.
CLASHING = (
    "id", "doc", "q", "key", "keys", "keeper", "src", "size", "place", "repeats", "lines", "left",
    "kept", "range", "text_", "c", "n", "digest", "regs", "anchors", "ranges", "copies", "label",
    "target", "copy", "threshold", "_dropped", "letters", "score", "start", "length", "a.dotted.name",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{c}` string" for c in CLASHING
)


def rows() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """``doc_id, text, lang, source``"""
    r = random.Random(5)
    vocabulary = ["ab", "Cde", "f.", "ghi,", "jk", "LMN", "op's", "(qr)", "s7", "größe", "日本語", "ét", "x" * 40]
    vocabulary += ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(300)]

    def prose(n, seed):
        q = random.Random(seed)
        return "".join(q.choice(vocabulary) + q.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))

    passage = prose(60, 99).replace("\n", " ")
    long = prose(30_000, 7)
    shared = "  The Same line In Many documents  "
    out = [(i, prose(40 + 7 * i, i), ("en", "de", None)[i % 3], ("a", "b", None, "Z")[i % 4]) for i in range(24)]
    out += [
        (30, None, "en", "a"),
        (31, "", "de", "b"),
        (32, " \t\n\x0b\x0c\r ", None, None),
        (33, "word", "en", "a"),
        (34, "a b c d", "en", "a"),
        (35, "a  b\tc\nd", "en", "a"),
        (36, long, "en", "hot"),
        (37, long + " more words at the end", "en", "hot"),
        (38, "y" * 200_000, None, "hot"),
        (39, "same " * 3000, "en", "hot"),
        (40, "1" * 50_000 + " 2 3 4 " + "5 " * 20_000, None, "hot"),
        (None, prose(80, 3), "en", None),
        (None, prose(333, 12), None, "a"),
        (41, None, None, None),
        (5, prose(75, 5), "en", "b"),
        (5, "another text with the same id as one that was there before it", "de", "b"),
        (50, f"{prose(50, 50)}\n{shared}\n{passage} tail one", "en", "a"),
        (51, f"{shared.lower()}\n{prose(55, 51)} {passage}", "en", "a"),
        (52, f"{passage}\n{shared.upper()}\n{shared}\n{prose(45, 52)}", "en", "b"),
        (53, f"{shared}\n{shared.strip()}", "en", "b"),
        (60, "mail me.too@example.org, a@b.cx_d@e.fg or @x.y; 10.0.0.256 1.2.3.4.5.6.7.8 010.1.2.003", "en", "a"),
        (61, "card 4111 1111-1111 1111 or 4111111111111112, 79927398713 4 12 34--56; +1 (555) 010-9999. +49", "en", "a"),
        (62, "iban GB82 WEST 1234 5698 7654 32 und tel (089) 123 45678 größe +44 20 7946 0958", "de", "a"),
        (63, "\U0001f600 a@b.co \U0001f600\U0001f600 192.168.0.1", None, "a"),
    ]
    for k in range(70, 82):
        out.append((k, prose(200, 1), "en", "hot"))  # copies
        edited = prose(200, 1).split(" ")
        edited[3 * (k - 70)] = f"changed{k}"
        out.append((k + 20, " ".join(edited), "en", "hot"))  # near copies
    q = random.Random(11)
    q.shuffle(out)
    return out


def frame(spark):
    filled = [
        (i, t, lang, s, None if t is None else len(t), *[f"{c}-{n}" if n % 3 else None for c in CLASHING])
        for n, (i, t, lang, s) in enumerate(rows())
    ]
    return spark.createDataFrame(filled, SCHEMA).repartition(5)
