"""Labelled lines for the span model, made from patterns by a seeded draw.

Each text comes with the places of its personal data; all its other numbers and words are counterexamples.
"""

from __future__ import annotations

import random
import re

WORDS = (
    "the river rose in night and by morning lower fields were under water as they had been most springs that anyone could remember we met her there before noon "
    "der Fluss stieg wieder und am Morgen standen die Wiesen unter Wasser wie fast immer la rivière est montée dans la nuit et les champs étaient sous eau "
    "el río subió por la noche los campos estaban bajo agua como casi todos años").split()
CUES = {
    "phone": ["call", "phone:", "Tel.", "tel", "mobile", "fax:", "Telefon", "téléphone :", "teléfono", "reach me on", "text me at", "WhatsApp"],
    "card": ["card", "credit card number", "Visa", "MasterCard:", "pay with card no.", "Kreditkarte", "carte bancaire", "tarjeta"],
    "ip": ["IP", "ip address", "host", "server", "from", "logged in from", "Adresse IP", "ping"],
    "email": ["email", "e-mail:", "mail", "write to", "contact", "E-Mail an", "courriel", "correo", "reach me at"],
}
OTHER = ["ISBN", "invoice", "order no.", "on", "page", "in", "figure", "version", "SKU", "see", "total", "seit", "en", "about", "issue", "ref.", "between", "population", "token", "Rechnung Nr."]
NAMES = ["anna", "b.meyer", "john", "j.smith", "clara_92", "luis", "info", "office", "marie-claire", "sales7"]
HOSTS = ["example", "mail5.example", "post", "valley-news", "uni-mill", "riverside"]
ENDS = ["com", "org", "net", "de", "fr", "es", "io", "edu", "co.uk"]


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(draw: random.Random, pattern: str) -> str:
    """``#`` is a digit, ``%`` one from 1 to 9."""
    return re.sub("[#%]", lambda m: str(draw.randrange(m[0] == "%", 10)), pattern)


def _card(draw: random.Random, good: bool) -> str:
    while True:
        digits = _digits(draw, draw.choice(["4###############", "5###############", "37#############", "6011############"]))
        if passes_luhn(digits) == good:
            return digits


def _ip(draw: random.Random) -> list[str]:
    return [str(draw.choice([draw.randrange(10), draw.randrange(10, 100), draw.randrange(100, 256)])) for _ in range(4)]


def _positive(draw: random.Random, kind: str) -> str:
    if kind == "phone":
        return _digits(draw, draw.choice([
            "(%##) ###-####", "(%##)###-####", "%##-###-####", "%##.###.####", "%## ### ####", "0%# #######", "01%# ########", "0%#/#######", "0%##-######", "0# ## ## ## ##", "0#.##.##.##.##",
            "6## ### ###", "9# ### ## ##", "00 %# ## #######", "00%#-##-#######", "1-%##-###-####", "(0%##) ######", "0%### ######"]))
    if kind == "card":
        digits, mark = _card(draw, True), draw.choice([".", "/", "  ", " - "])
        return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if kind == "ip":
        return draw.choice(["[.]", "(.)", " . ", "[dot]", " dot "]).join(_ip(draw))
    at, dot = draw.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" @ ", "."), (" (at) ", "."), ("[at]", "[dot]"), (" AT ", " DOT ")])
    return draw.choice(NAMES) + at + draw.choice(HOSTS).replace(".", dot) + dot + draw.choice(ENDS).replace(".", dot)


def _negative(draw: random.Random) -> str:
    choice = draw.randrange(16)
    if choice == 0:
        return f"{draw.randrange(1900, 2030)}-{draw.randrange(1, 13):02}-{draw.randrange(1, 29):02}"
    if choice == 1:
        return f"{draw.randrange(1, 29):02}.{draw.randrange(1, 13):02}.{draw.randrange(1900, 2030)}"
    if choice == 2:
        return f"{draw.randrange(1, 13):02}/{draw.randrange(1, 29):02}/{draw.randrange(1900, 2030)} - {draw.randrange(1, 13):02}/{draw.randrange(1, 29):02}/{draw.randrange(1900, 2030)}"
    if choice == 3:
        return _digits(draw, draw.choice(["% ### ###", "%## ### ###", "%.###.###", "%#.###.###.###", "%#######", "%########", "%##########", "%############", "%###############"]))
    if choice == 4:
        return _digits(draw, draw.choice(["978-%-##-######-#", "979-##-###-####-#", "####-####", "978 % ## ###### #"]))
    if choice == 5:
        return " ".join(str(draw.randrange(1, 99)) for _ in range(draw.randrange(4, 10)))
    if choice == 6:
        return " ".join(str(y) for y in range(draw.randrange(1900, 1990), 2000)[:draw.randrange(2, 5)])
    if choice == 7:
        digits, mark = _card(draw, False), draw.choice(["", " ", "-", ".", "/"])
        return mark.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    if choice == 8:
        return _digits(draw, "%#.#.###.#") + draw.choice(["", "-rc.#", " (##)"]).replace("#", "2")
    if choice == 9:
        return f"{draw.randrange(1, 900)}.{draw.randrange(10)} {draw.randrange(1, 900)}.{draw.randrange(10)} {draw.randrange(1, 900)}.{draw.randrange(100)}"
    if choice == 10:
        return "look at the dot on the " + draw.choice(["map", "page", "wall"])
    if choice == 11:
        return draw.choice(["they stood at noon. The", "arrived at home dot by dot in", "meet at five . Then", "at last. com", "was at ease dot dot dot", "a @ b", "5 @ 3.50 each", "seen at the mill (dot 4)"])
    if choice == 12:
        return _digits(draw, draw.choice(["%#/##/##/##", "%/#/#/#/#/#/#", "(%) (#) (#) (#) (#) (#) (#)", "[%#] [##] [##] [##]", "%###-%###", "%###/%###", "###-##-##-##-##"]))
    if choice == 13:
        return _digits(draw, draw.choice(["%#:##:## %#:##:##", "%##,### ###", "%.##e+##", "%###.####, %##.####", "%#.###### %#.######"]))
    if choice == 14:
        return "".join(draw.choice("0123456789abcdef") for _ in range(40))
    return _digits(draw, draw.choice(["%##", "%#", "%###", "% of %#", "%#.#"]))


def examples(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts, each with its spans ``(start, end, kind)``."""
    draw, out = random.Random(seed), []
    for _ in range(count):
        text, spans = "", []
        for _ in range(draw.randrange(1, 4)):
            text += " ".join(draw.choice(WORDS) for _ in range(draw.randrange(2, 7))) + draw.choice([" ", " ", ", ", ". "])
            if draw.random() < 0.5:
                kind = draw.choice(["phone", "phone", "card", "ip", "email", "email"])
                cue = draw.choice(CUES[kind]) + " " if draw.random() < 0.7 else ""
                found = _positive(draw, kind)
                spans.append((len(text) + len(cue), len(text) + len(cue) + len(found), kind))
            else:
                cue = draw.choice(OTHER) + " " if draw.random() < 0.7 else ""
                found = _negative(draw)
            text += cue + found + draw.choice([" ", " ", ", ", ". ", "; ", "\n"])
        out.append((text, spans))
    return out
