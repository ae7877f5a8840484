"""Labelled spans to learn from: sentences with personal data and with look-alikes, drawn from templates.

The labels come from the templates alone, not from any pattern or check sum, so what the trees learn is
independent of the candidate patterns. A seed fixes the set; its size is a parameter. Rows of a fold of
three are for fitting, for calibration and for tests.
"""

from __future__ import annotations

import random

FITTING, CALIBRATION, TESTING = 0, 1, 2
_NAMES = ["anna", "j.miller", "support", "info2", "max_w", "sales", "r2d2", "kim-lee", "office", "tom"]
_HOSTS = ["example", "mail", "acme-corp", "north", "uni-west", "shop24", "post", "lab"]
_ENDS = ["com", "org", "net", "de", "edu", "io", "fr", "info"]
_WORDS = "the of a house river light some people then over morning near stone paper when old long small market again".split()

# Sentences around a span, by kind. {} is the span; positives first, then look-alikes.
_PHONE = (["call {} now", "tel: {}", "phone {}", "reach me at {} today", "fax {}.", "mobile {}, thanks", "my number is {}"], ["part {}", "order {} shipped", "item no {}", "serial {}", "lot {} of", "version {}", "tracking {}", "ref {}", "invoice {}"])
_EMAIL = (["write to {} please", "contact {}", "mail {}", "e-mail: {}", "reach {} anytime"], ["we {} again", "they {} then", "people {} slowly", "look {} here"])
_IP = (["server {}", "host {} is up", "ip {}", "from address {}", "ping {}"], ["version {}", "oid {}", "section {}", "build {}", "release {}", "chapter {}"])
_CARD = (["card {}", "visa {} ok", "paid with card {}", "pay {}", "account {}"], ["tracking {}", "serial {}", "order {}", "invoice {}", "sequence {}", "ref {}", "lot {}"])
_SECRET = (['token = "{}"', "api_key: {}", "secret={}", "password = {}", "Bearer {}", "auth token {}", "access key {}"], ["sha256 {}", "commit {}", 'checksum = "{}"', "md5: {}", "etag {}", "file {}", "hash {}", "uuid {}"])


def luhn_digits(rng: random.Random, n: int) -> str:
    digits = [rng.randrange(10) for _ in range(n - 1)]
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return "".join(map(str, digits)) + str(-total % 10)


def _grouped(digits: str, sizes: list[int], sep: str) -> str:
    out, at = [], 0
    for s in sizes:
        out.append(digits[at : at + s])
        at += s
    return sep.join(out)


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _span(rng: random.Random, kind: str, positive: bool) -> tuple[str, ...]:
    """The span with what stands directly before and after it, and a second span after that, if any."""
    if kind == "phone":
        a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        sep = rng.choice("- .") if positive or rng.random() < 0.7 else rng.choice("-.")
        return "", f"({a}) {b}{sep}{c}" if positive and rng.random() < 0.4 else f"{a}{sep}{b}{sep}{c}", ""
    if kind == "email":
        if positive:
            at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" [at] ", " dot ")])
            return "", rng.choice(_NAMES) + at + rng.choice(_HOSTS) + dot + rng.choice(_ENDS), ""
        return "", f"{rng.choice(['arrived', 'stared', 'looked', 'met', 'pointed'])} at {rng.choice(['that', 'the', 'one', 'noon'])} dot {rng.choice(['over', 'again', 'there', 'which', 'under'])}", ""
    if kind == "ip":
        parts = [str(rng.randrange(1, 255)) for _ in range(4)]
        span = ".".join(parts)
        if positive:
            return rng.choice([("", span, f".{rng.randrange(1024, 65535)}"), (f"{rng.randrange(256, 999)}.", span, "")])
        small = [str(rng.randrange(0, 30)) for _ in range(rng.randrange(5, 9))]
        return "", ".".join(small), ""
    if kind == "card":
        if positive:
            n = rng.choice([16, 16, 16, 15, 14])
            digits = luhn_digits(rng, n)
            sizes = {16: [4] * 4, 15: [4, 6, 5], 14: [4, 6, 4]}[n]
            span = digits if rng.random() < 0.4 else _grouped(digits, sizes, rng.choice(" -"))
            before = f"{_number(rng, rng.randrange(1, 4))} " if rng.random() < 0.2 else ""
            second = luhn_digits(rng, 16)
            if rng.random() < 0.5:
                return before, span, " ", second if rng.random() < 0.5 else _grouped(second, [4] * 4, " ")
            return before, span, rng.choice([f" {_number(rng, 3)}", " 10", f" {_number(rng, 2)} {_number(rng, 2)}"])
        sizes = [rng.randrange(1, 7) for _ in range(rng.randrange(5, 14))]
        return "", _grouped(_number(rng, sum(sizes)), sizes, rng.choice(" -")), ""
    alphabet = "0123456789abcdef" if rng.random() < 0.6 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"
    n = rng.choice([32, 40, 64]) if alphabet[10] == "a" else rng.randrange(20, 48)
    return "", "".join(rng.choice(alphabet) for _ in range(n)), ""


def examples(per_case: int = 400, seed: int = 7) -> list[tuple[int, str, list[str], int]]:
    """(id, text, true spans as kind:start:end, fold); per kind ``per_case`` texts with a true span and as many look-alikes."""
    rng = random.Random(seed)
    rows = []
    for kind, (good, bad) in {"phone": _PHONE, "email": _EMAIL, "ip": _IP, "card": _CARD, "secret": _SECRET}.items():
        for positive in (True, False):
            for i in range(per_case):
                before, span, after, second = (*_span(rng, kind, positive), "")[:4]
                frame = rng.choice(good if positive else bad)
                if rng.random() < 0.15:
                    frame = "{}" if positive and kind != "ip" and kind != "secret" else frame
                head, tail = (f"{x} " if x else "" for x in (" ".join(rng.choices(_WORDS, k=rng.randrange(0, 6))), ""))
                left, right = frame.split("{}")
                at = len(head + left + before)
                then = at + len(span + after)
                text = head + left + before + span + after + second + right + " " + " ".join(rng.choices(_WORDS, k=rng.randrange(0, 6)))
                true = [f"{kind}:{at}:{at + len(span)}", *([f"{kind}:{then}:{then + len(second)}"] if second else [])]
                rows.append((len(rows), text, true if positive else [], i % 3))
    return rows
