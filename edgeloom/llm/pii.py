"""Personal data: candidate generators, boosted trees, calibrated thresholds.

Base spans follow fixed rules. Beside them, several high-recall generators a kind
propose spans that may overlap each other and anything else; boosted trees score each
by its format and context, and a threshold per kind, calibrated on held-out examples,
selects what is added. Of chosen candidates that overlap, the one with the highest
score stays. The trees are fitted on generated texts when the module is first used;
on the main path they are constant arrays walked by built-in functions.

The generated texts hold personal data and look-alikes of the same formats, in and out
of context, with noise on every sign: card numbers with a wrong digit, order numbers
that pass Luhn, phone numbers after no hint, hints before part numbers. So no single
feature decides.

Patterns start a run only at its beginning and repeat possessively: a run that fails
at its beginning fails everywhere, so long runs cost one attempt and no recursion.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

KINDS = ("email", "ip", "card", "phone")

#: Base patterns by kind. Same matches as the plain forms
#: email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card   [0-9]([\x20-]?[0-9])+, of which only runs of 13 to 19 digits
#: phone  \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: High-recall generators by kind; a candidate is what one of them matches.
GENERATE = {
    "email": tuple(
        rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+(?:{at})[a-z0-9-]{{1,63}}+{rest}"
        for at in (r" ?[\[({<] ?at ?[\])}>] ?", " at ", " ?@ ?")
        # dots in any form, or one dot only: the end of a sentence may follow
        for rest in (r"(?:(?: ?[\[({<] ?dot ?[\])}>] ?| dot | ?\. ?)[a-z0-9-]{1,63}+){1,4}", r"(?: ?[\[({<] ?dot ?[\])}>] ?| dot | ?\.)[a-z0-9-]{2,63}+")
    ),
    "ip": (
        r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
        r"(?i)(?<![0-9])[0-9]{1,3}(?: ?(?:[\[(] ?(?:\.|dot) ?[\])]) ?[0-9]{1,3}| dot [0-9]{1,3}| \. [0-9]{1,3}){3}(?![0-9])",
        r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    ),
    "card": (
        r"(?<![0-9])[0-9]{4}([\x20.-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        r"(?<![0-9])3[0-9]{3}([\x20.-]?)[0-9]{6}\1[0-9]{5}(?![0-9])",
        r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
        r"(?<![0-9])(?:\+|00)[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
        r"(?<![0-9])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    ),
}

#: What must be in a text before its generators run (cheap tests).
NEED = {
    "email": r"(?i)[\[({<] ?at ?[\])}>]| at [a-z0-9-]{1,63}+(?: ?[\[({<] ?dot| dot |\.[a-z])|@",
    "ip": r"(?i)[0-9]\.[0-9]|[0-9] ?[\[(] ?(?:\.|dot)|[0-9] (?:dot|\.) [0-9]|[0-9a-f]::?[0-9a-f]",
    "card": r"[0-9]{4}[\x20.-]?[0-9]{4}|[0-9]{4}[\x20.-]?[0-9]{6}",
    "phone": r"[0-9]{3}[\x20.-]?[0-9]{4}",
}

#: Characters of context before and after a candidate.
LEAD, TAIL = 24, 16
#: Context hints by kind, and hints that a candidate is something else.
HINT = {
    "email": r"(?i)e-?mail|contact|write|reach|send|address|reply|inbox",
    "ip": r"(?i)(?<![a-z])ip(?![a-z])|ipv6|host|server|address|from|client|login|ping|connect",
    "card": r"(?i)card|visa|master|amex|credit|debit|paid|payment|charge|cvv|expir",
    "phone": r"(?i)(?<![a-z])(?:tel|phone|call|mobile|cell|fax|contact|dial|ring|text me|sms|whatsapp)",
}
AGAINST = r"(?i)version|(?<![a-z])v$|isbn|order|serial|section|build|part n|(?<![a-z])id[:=# ]|invoice|tracking|sku|ref(?![a-z])|model|release|score|page|chapter|time|mac(?![a-z])"

#: Endings a mail host commonly has.
ENDINGS = "com|org|net|edu|gov|io|info|de|fr|es|it|nl|uk|eu|co|example|test"
#: Words before a written "at" in plain prose.
PROSE = "look|looked|meet|meeting|arrive|arrived|was|is|be|were|are|stay|stayed|live|lives|lived|based|available|shop|buy|visit|found|see|stop|stopped|work|works|sold|read|up|us|it|them|him|me"

#: Features: how, and of what. `count` characters of a class in the match, `match`, `lead`
#: and `tail` search a pattern there, `group` is the number of pieces a class has.
SHARED = (
    ("digits", "count", "0-9"),
    ("seps", "count", r"\x20.-"),
    ("length", "count", r"\x00-￿"),
    ("glued before", "lead", r"[A-Za-z0-9_+#/=.(-]$"),
    ("glued after", "tail", r"^[A-Za-z0-9_#/=@-]"),
    ("numbers before", "lead", r"[0-9][^A-Za-z]{0,3}$"),
    ("numbers after", "tail", r"^[^A-Za-z]{0,3}[0-9]"),
    ("phone before", "lead", r"[0-9]{3}[\x20.-][0-9]{4} $"),
    ("long number after", "tail", r"^ [0-9]{4}"),
    ("against", "lead", AGAINST),
    ("label before", "lead", r"[:=] ?$"),
)
OWN = {
    "email": (
        ("bracketed at", "match", r"(?i)[\[({<] ?at ?[\])}>]"),
        ("sign", "match", "@"),
        ("bracketed dot", "match", r"(?i)[\[({<] ?dot ?[\])}>]"),
        ("written dot", "match", r"(?i) dot "),
        ("dot and blank", "match", r"\. "),
        ("ending", "match", rf"(?i)(?:[\x20.\])}}>])(?:{ENDINGS})$"),
        ("name with marks", "match", r"^[A-Za-z0-9._%+-]*[0-9._+-][A-Za-z0-9._%+-]*(?: |@|[\[({<])"),
        ("prose", "match", rf"(?i)^(?:{PROSE}) "),
    ),
    "ip": (
        ("octets", "octets", ""),
        ("version like", "match", r"^[0-9]{1,2}(?:\.[0-9]{1,2}){3}$"),
        ("defanged", "match", r"(?i)[\[(] ?(?:\.|dot)"),
        ("colons", "count", ":"),
        ("double colon", "match", "::"),
        ("hex", "match", "[A-Fa-f]"),
        ("pairs", "match", r"^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2})+$"),
        ("long group", "match", r"[0-9A-Fa-f]{4}"),
    ),
    "card": (
        ("luhn", "luhn", ""),
        ("issuer", "match", r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        ("grouped", "match", r"^[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([\x20.-])[0-9]{6}\2[0-9]{5}$"),
    ),
    "phone": (
        ("plus", "match", r"^\+"),
        ("bracket", "match", r"^\+?[0-9\x20.-]*\([0-9]{2,4}\)"),
        ("torn bracket", "match", r"^[^(]*\)|\([^)]*$"),
        ("double zero", "match", "^00"),
        ("grouped", "match", r"^\(?[0-9]{3}\)?([\x20.-])[0-9]{3}[\x20.-][0-9]{4}$"),
        ("short", "match", r"^[0-9]{3}[\x20.-][0-9]{4}$"),
        ("area starts low", "match", r"^\(?[01]"),
    ),
}


def feature_list(kind: str) -> tuple:
    return (*SHARED, ("hint before", "lead", HINT[kind]), ("hint after", "tail", HINT[kind]), *OWN[kind])


#: Spans handled at once by scan; a text's spans are added up block by block.
BLOCK = 128
SPAN = "struct<s:int,e:int,bs:int,be:int,m:string>"


def scan(items: Column, kind: str, zero: Column, state: str, step, out, made: str) -> Column:
    """array<made>: out(state, item) for each item of array<kind>, the state going on by step.

    Arrays grow by appending, so whole blocks are appended, not single items.
    """
    inner, outer = f"struct<st:{state},out:array<{made}>>", f"struct<st:{state},out:array<array<{made}>>>"

    def one(st: Column, chunk: Column) -> Column:
        grow = lambda a, x: F.struct(step(a["st"], x).alias("st"), F.concat(a["out"], F.array(out(a["st"], x))).alias("out")).cast(inner)
        return F.aggregate(chunk, F.struct(st.alias("st"), F.array().cast(f"array<{made}>").alias("out")).cast(inner), grow)

    def block(a: Column, chunk: Column) -> Column:
        return let(one(a["st"], chunk), lambda r: F.struct(r["st"].alias("st"), F.concat(a["out"], F.array(r["out"])).alias("out")).cast(outer))

    items = items.cast(f"array<{kind}>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    first = F.struct(zero.alias("st"), F.array().cast(f"array<array<{made}>>").alias("out")).cast(outer)
    return F.when(F.size(items) == 0, F.array().cast(f"array<{made}>")).otherwise(F.flatten(F.aggregate(blocks, first, block)["out"]))


def spans_of(text: Column, pattern: Column) -> Column:
    """array<SPAN>: matches from the left with code-point and byte offsets, ends exclusive.

    The pieces between matches and the matches alternate, so offsets are running sums.
    A null pattern matches nothing.
    """
    item, state = "struct<g:string,m:string>", "struct<at:int,bat:int>"

    def run(found: Column) -> Column:
        zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"), found.alias("m"))

        def step(st: Column, x: Column) -> Column:
            return F.struct((st["at"] + F.char_length(x["g"]) + F.char_length(x["m"])).alias("at"), (st["bat"] + F.octet_length(x["g"]) + F.octet_length(x["m"])).alias("bat"))

        def out(st: Column, x: Column) -> Column:
            s, bs = st["at"] + F.char_length(x["g"]), st["bat"] + F.octet_length(x["g"])
            return F.struct(s.alias("s"), (s + F.char_length(x["m"])).alias("e"), bs.alias("bs"), (bs + F.octet_length(x["m"])).alias("be"), x["m"].alias("m"))

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("bat"))
        many = let(zipped, lambda z: scan(z, item, zero, state, step, out, SPAN))
        return F.when(F.size(found) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(many)

    return let(F.coalesce(F.regexp_extract_all(text, pattern, F.lit(0)), F.array().cast("array<string>")), run)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _octets(m: Column) -> Column:
    return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.char_length(digits(m)).between(9, 15)
    return F.lit(True)


def luhn(m: Column) -> Column:
    return F.call_function("luhn_check", digits(m))


def features(kind: str, m: Column, lead: Column, tail: Column) -> Column:
    """array<bigint>: the features of feature_list(kind) for one match and its context."""
    num = lambda x: F.coalesce(x, F.lit(False)).cast("long")

    def one(how: str, what: str) -> Column:
        if how == "count":
            kept = F.regexp_replace(m, f"[^{what}]", "") if what != r"\x00-￿" else m
            return F.char_length(kept).cast("long")
        if how == "luhn":
            return num(luhn(m))
        if how == "octets":
            return num(_octets(m))
        return num({"match": m, "lead": lead, "tail": tail}[how].rlike(what))

    return F.array(*[one(how, what) for _, how, what in feature_list(kind)])


def row_of(kind: str, m: str, lead: str, tail: str) -> list[int]:
    """The same features on the driver, for generated examples."""

    def one(how: str, what: str) -> int:
        if how == "count":
            return len(re.sub(f"[^{what}]", "", m)) if what != r"\x00-￿" else len(m)
        if how == "luhn":
            return int(_luhn(m))
        if how == "octets":
            return int(bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", m)) and all(int(x) < 256 for x in m.split(".")))
        return int(bool(re.search(what, {"match": m, "lead": lead[-LEAD:], "tail": tail[:TAIL]}[how], re.ASCII)))

    return [one(how, what) for _, how, what in feature_list(kind)]


def _luhn(m: str) -> bool:
    d = [int(x) for x in reversed(re.sub("[^0-9]", "", m))]
    return bool(d) and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


class Writer:
    """Seeded texts with one piece of personal data or one look-alike each."""

    def __init__(self, kind: str, seed: int):
        self.kind, self.rnd = kind, random.Random(f"{kind}:{seed}")

    def digit(self, k: int, first: str = "0123456789") -> str:
        return "".join(self.rnd.choice(first if i == 0 else "0123456789") for i in range(k))

    def name(self, least: int = 3, most: int = 9) -> str:
        return "".join(self.rnd.choice("abcdefghiklmnoprstuéñ" if self.rnd.random() < 0.03 else "abcdefghiklmnoprstu") for _ in range(self.rnd.randint(least, most)))

    def plain(self) -> str:
        return "".join(self.rnd.choice("abcdefghiklmnoprstu") for _ in range(self.rnd.randint(3, 9)))

    def pick(self, *options):
        return self.rnd.choice(options)

    def email(self, good: bool) -> str:
        p = self.rnd.random()
        if good:
            local = self.pick(self.plain(), self.plain() + self.pick(".", "_", "") + self.plain(), self.plain() + self.digit(2))
            at = self.pick("(at)", "[at]", " (at) ", " [at] ", " at ", " @ ", "{at}")
            dot = self.pick(".", ".", "(dot)", " [dot] ", " dot ") if at != " at " or p < 0.5 else " dot "
            return local + at + self.plain() + dot + (self.plain()[:3] if p > 0.8 else self.pick("com", "org", "net", "de", "example", "io"))
        if p < 0.3:
            return self.pick(*PROSE.split("|")) + " at " + self.plain() + self.pick(". ", ".") + self.plain()
        if p < 0.5:
            return self.plain() + " at " + self.plain() + self.pick(". The", ". A", " dot " + self.plain())
        if p < 0.65:
            return self.plain() + self.pick(" (at) ", " [at] ") + self.plain() + self.pick(". ", ". And ") + self.plain()
        if p < 0.85:
            return self.pick(self.plain(), *PROSE.split("|")[:12]) + self.pick(" at ", " at ", " (at) ") + self.plain() + "." + self.pick("com", "org", "net")
        return self.plain() + self.pick(" @ ", " @") + self.plain() + self.pick(". ", ". The ") + self.plain()

    def ip(self, good: bool) -> str:
        p = self.rnd.random()
        part = lambda: str(self.rnd.randint(0, 255))
        hexes = lambda n, k: ":".join("".join(self.rnd.choice("0123456789abcdef") for _ in range(k)) for _ in range(n))
        if good:
            if p < 0.3:
                sep = self.pick("[.]", "(.)", " [.] ", "[dot]", " dot ", " . ")
                return sep.join(part() for _ in range(4))
            if p < 0.6:
                return self.pick(hexes(8, 4), f"{hexes(3, 4)}::{hexes(1, 2)}", f"{hexes(2, 4)}::{hexes(2, 3)}")
            return ".".join(part() for _ in range(4))
        if p < 0.25:
            return ":".join(self.digit(2) for _ in range(self.pick(3, 4)))
        if p < 0.4:
            return hexes(6, 2)
        if p < 0.55:
            return ".".join(self.digit(self.pick(1, 2, 2)) for _ in range(4))
        if p < 0.7:
            return " . ".join(self.digit(self.pick(1, 2, 3)) for _ in range(4))
        if p < 0.8:
            return ":".join(self.digit(self.pick(1, 2, 4)) for _ in range(self.pick(3, 4, 5)))
        return ".".join(str(self.pick(self.rnd.randint(0, 255), self.rnd.randint(256, 999))) for _ in range(4))

    def card(self, good: bool) -> str:
        n = self.pick(16, 16, 16, 15)
        d = self.pick("34", "37") if n == 15 else self.pick("4", "51", "55", "6011", "2221")
        if not good and self.rnd.random() < 0.6:
            d, n = self.digit(2, "123456789"), self.pick(13, 14, 15, 16, 16, 17, 18, 19)
        d += self.digit(n - 1 - len(d))
        wanted = self.rnd.random() < (0.93 if good else 0.12)
        d += next(x for x in self.rnd.sample("0123456789", 10) if _luhn(d + x) == wanted)
        sep = self.pick(" ", "-", ".", "") if self.rnd.random() < (0.75 if good else 0.35) else ""
        if n == 16:
            return sep.join(d[k : k + 4] for k in (0, 4, 8, 12))
        return sep.join((d[:4], d[4:10], d[10:])) if n == 15 else d

    def phone(self, good: bool) -> str:
        p, sep = self.rnd.random(), self.pick("-", ".", " ")
        area = self.digit(3, "23456789" if good or p < 0.6 else "0123456789")
        if good:
            if p < 0.35:
                return f"({area}){self.pick(' ', '-', '')}{self.digit(3)}{self.pick('-', '.', ' ')}{self.digit(4)}"
            if p < 0.7:
                return sep.join([area, self.digit(3), self.digit(4)])
            if p < 0.85:
                return f"{self.pick('+', '00')}{self.digit(self.pick(1, 2), '123456789')}{sep}{area}{sep}{self.digit(3)}{sep}{self.digit(4)}"
            return f"{self.digit(3, '23456789')}{sep}{self.digit(4)}"
        if p < 0.4:
            return sep.join([area, self.digit(3), self.digit(4)])
        if p < 0.6:
            return sep.join([self.digit(self.pick(2, 4)), self.digit(3), self.digit(4)])
        if p < 0.7:
            return f"({self.digit(self.pick(2, 4))}) {self.digit(3)}{sep}{self.digit(4)}"
        if p < 0.8:
            return "00" + self.digit(self.pick(9, 10, 11, 12, 13, 14))
        return sep.join([self.digit(3), self.digit(4)])

    def text(self) -> tuple[str, int, int, bool]:
        """A text, the place of the number or name in it, and whether it is personal."""
        good = self.rnd.random() < 0.5
        value = getattr(self, self.kind)(good)
        yes = {
            "email": ("email: ", "mail me at ", "contact ", "write to ", "reach me: ", "reply to "),
            "ip": ("from host ", "server ", "client ip ", "ip: ", "address ", "connect to "),
            "card": ("card ", "visa: ", "paid with ", "credit card number ", "charge ", "card no. "),
            "phone": ("call ", "phone: ", "mobile ", "tel. ", "fax ", "dial "),
        }[self.kind]
        no = ("version ", "order ", "serial ", "section ", "build ", "invoice ", "part no ", "tracking ", "model ", "ref ", "id: ", "sku ")
        p = self.rnd.random()
        filler = " ".join(self.name() for _ in range(self.rnd.randint(2, 6))) + " "
        if good:
            lead = self.pick(*yes) + (self.pick("us on ", "me: ", "is ") if self.rnd.random() < 0.2 else "") if p < 0.8 else self.pick(*no) if p < 0.82 else ""
        else:
            lead = self.pick(*no) + self.pick("", "", "no. ", "#") if p < 0.55 else self.pick(*yes) + self.pick(*no) if p < 0.65 else self.pick(*yes) if p < 0.655 else self.digit(self.pick(1, 3)) + self.pick(" ", ", ") if p < 0.78 else ""
        beside = good and self.rnd.random() < 0.15  # another personal number next to it
        if beside and self.kind == "card":
            lead = f"{self.pick('+1 ', '')}({self.digit(3)}) {self.digit(3)}-{self.digit(4)} "
        after = f" {self.digit(16, '3456')} " if beside and self.kind == "phone" and value[0] in "+(" else self.pick(" ", ". ", ", ", "; ", "\n") if good or self.rnd.random() < 0.7 else self.pick("x ", "/2 ", "#", "_a ", " " + self.digit(3) + " ")
        if self.rnd.random() < 0.05:
            after = f" ({yes[0].strip(' :')})"
        text = filler + lead + value + after + self.plain() + " " + self.name()
        at = len(filler) + len(lead)
        return text, at, at + len(value), good


def candidates(kind: str, text: str) -> list[tuple[int, int]]:
    """What the generators propose, on the driver."""
    return sorted({m.span() for p in GENERATE[kind] for m in re.finditer(p, text, re.ASCII)})


def examples(kind: str, n: int, seed: int) -> list[tuple[list[int], int]]:
    """Candidates of n generated texts: features, and 1 for exactly the personal piece."""
    writer, out = Writer(kind, seed), []
    for _ in range(n):
        text, start, end, good = writer.text()
        out += [(row_of(kind, text[a:b], text[:a], text[b:]), int(good and (a, b) == (start, end))) for a, b in candidates(kind, text)]
    return out


#: Numbers of a tree of three levels: 7 features, 7 cuts, 8 leaves in millionths.
NODES, LEAVES, UNIT = 7, 8, 1_000_000
WIDTH = 2 * NODES + LEAVES


def boost(rows: list[tuple[list[int], int]], rounds: int = 40, rate: float = 0.3, ridge: float = 2.0) -> np.ndarray:
    """Second-order gradient boosting of trees of three levels under log loss.

    One row of WIDTH whole numbers a tree. A value above a node's cut goes right.
    """
    x, y = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    tests = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)).astype(np.int64))[:-1]]
    right = np.stack([x[:, f] > c for f, c in tests], axis=1)
    margin, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        tree, members = [0] * WIDTH, {0: np.ones(len(y), bool)}
        for node in range(NODES):
            at = members[node]
            gr, hr = (g * at) @ right, (h * at) @ right
            ga, ha = (g * at).sum(), (h * at).sum()
            gain = gr**2 / (hr + ridge) + (ga - gr) ** 2 / (ha - hr + ridge) - ga**2 / (ha + ridge)
            best = int(gain.argmax())
            tree[node], tree[NODES + node] = tests[best] if gain[best] > 1e-6 else (0, 2**31)
            side = right[:, best] if gain[best] > 1e-6 else np.zeros(len(y), bool)
            members[2 * node + 1], members[2 * node + 2] = at & ~side, at & side
        for k in range(LEAVES):
            at = members[NODES + k]
            tree[2 * NODES + k] = round(-rate * g[at].sum() / (h[at].sum() + ridge) * UNIT)
            margin += at * (tree[2 * NODES + k] / UNIT)
        trees.append(tree)
    return np.array(trees, np.int64)


def value(trees: np.ndarray, x: list[int]) -> int:
    """The margin of one candidate, in millionths."""
    total = 0
    for t in trees.tolist():
        node = 0
        while node < NODES:
            node = 2 * node + 1 + (x[t[node]] > t[NODES + node])
        total += t[NODES + node]
    return total


@lru_cache(maxsize=8)
def model(kind: str, n: int = 3000, precision: float = 0.98) -> tuple[np.ndarray, int]:
    """(trees, threshold): the least margin from which on held-out examples, made from another
    seed, are right with the given precision; margins below 0 never count."""
    trees = boost(examples(kind, n, 1))
    held = examples(kind, n, 2)
    margins = np.array([value(trees, x) for x, _ in held])
    truth = np.array([y for _, y in held])
    order = np.argsort(-margins, kind="stable")
    sure = np.cumsum(truth[order]) >= precision * np.arange(1, len(order) + 1)
    last = np.flatnonzero(sure & (np.append(margins[order][1:], -(2**62)) < margins[order]) & (margins[order] >= 0))
    return trees, int(margins[order][last[-1]]) if len(last) else 2**62


def _margin(x: Column, trees: np.ndarray) -> Column:
    """The trees' sum for features x, all walked through one constant array."""
    table = F.split(F.lit(",".join(map(str, trees.ravel().tolist()))), ",").cast("array<bigint>")

    def walk(t: Column, base: Column) -> Column:
        down = lambda node: (F.get(x, F.get(t, base + node).cast("int")) > F.get(t, base + node + NODES)).cast("int")
        third = lambda n: F.get(t, base + NODES + 2 * n + 1 + down(n))
        return let(1 + down(F.lit(0)), lambda a: let(2 * a + 1 + down(a), third))

    def all_(t: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(trees) - 1)), F.lit(0).cast("long"), lambda acc, k: acc + walk(t, k * WIDTH))

    return let(table, all_)


def added(kind: str, raw: Column, proposed: Column, base: Column) -> Column:
    """Candidates whose score reaches the threshold and that touch no base span of the kind;
    of overlapping ones the highest score, then the longer, then the first. raw: the text's bytes."""
    trees, least = model(kind)
    scored = f"struct<v:bigint,n:int,c:{SPAN}>"

    def one(c: Column) -> Column:
        lead = F.substring(F.substring(raw, F.greatest(F.lit(1), c["bs"] + 1 - 4 * LEAD), F.least(c["bs"], F.lit(4 * LEAD))).cast("string"), -LEAD, LEAD)
        tail = F.substring(F.substring(raw, c["be"] + 1, F.lit(4 * TAIL)).cast("string"), 1, TAIL)
        v = let(F.struct(lead.alias("l"), tail.alias("t")), lambda k: let(features(kind, c["m"], k["l"], k["t"]), lambda x: _margin(x, trees)))
        return F.struct(v.alias("v"), (c["s"] - c["e"]).alias("n"), c.alias("c")).cast(scored)

    def best(found: Column) -> Column:
        beats = lambda q, o: (q["v"] > o["v"]) | ((q["v"] == o["v"]) & ((q["n"] < o["n"]) | ((q["n"] == o["n"]) & (q["c"]["s"] < o["c"]["s"]))))
        cross = lambda q, o: (q["c"]["s"] < o["c"]["e"]) & (o["c"]["s"] < q["c"]["e"])
        return F.transform(F.filter(found, lambda o: ~F.exists(found, lambda q: cross(q, o) & beats(q, o))), lambda o: o["c"])

    free = lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    return let(F.filter(F.transform(F.filter(F.array_distinct(proposed), free), one), lambda q: q["v"] >= least), best)


def _every_base(text: Column) -> Column:
    """array<array<SPAN>> by kind: matches of the base patterns, whether valid or not."""
    patterns = [F.when(text.contains("@"), F.lit(p)) if k == "email" else F.lit(p) for k, p in BASE.items()]
    return F.transform(F.array(*patterns), lambda p: spans_of(text, p))


def _proposed(text: Column) -> Column:
    """array<array<SPAN>> by kind: what the generators propose."""
    patterns = F.array(*[F.when(text.rlike(NEED[k]), F.array(*map(F.lit, GENERATE[k]))) for k in KINDS])
    return F.transform(patterns, lambda ps: F.coalesce(F.flatten(F.transform(ps, lambda p: spans_of(text, p))), F.array().cast(f"array<{SPAN}>")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, document (the row itself), <kind>_base and <kind>_spans
    (array<SPAN>) for every row.

    Offsets s and e are code points of the whole text, bs and be its UTF-8 bytes. Null
    texts are empty. Null and repeated ids are ordinary rows, repeated rows come out
    repeated, an empty table gives no rows; other columns are ignored, whatever their name.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("document"))
    own_valid = lambda every, kind: F.filter(F.get(every, KINDS.index(kind)), lambda c: _valid(kind, c["m"])).alias(kind)
    valid = lambda every: F.struct(*[own_valid(every, k) for k in KINDS])
    rows = rows.select("doc_id", "text", "document", let(_every_base(text), valid).alias("base"))

    def chosen(kind: str, raw: Column, proposed: Column) -> Column:
        own, mine = F.col("base")[kind], F.get(proposed, KINDS.index(kind))
        return F.when(F.size(mine) == 0, own).otherwise(F.array_sort(F.concat(own, added(kind, raw, mine, own))))

    found = let(_proposed(text), lambda p: let(text.cast("binary"), lambda raw: F.struct(*[chosen(k, raw, p).alias(k) for k in KINDS])))
    rows = rows.select("doc_id", "text", "document", "base", found.alias("spans"))
    return rows.select("doc_id", "text", "document", *[F.col("base")[k].alias(f"{k}_base") for k in KINDS], *[F.col("spans")[k].alias(f"{k}_spans") for k in KINDS])


def digest_line(columns: dict[str, Column]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""

    def part(kind: str) -> Column:
        return F.transform(columns[kind], lambda c: F.concat_ws(":", F.lit(kind), c["s"], c["e"]))

    return F.array_join(F.concat(*map(part, KINDS)), ",")


def redact(text: Column, spans: dict[str, Column]) -> Column:
    """text with every span replaced by [KIND]; of overlapping spans the first, then the longest, names it."""
    item = "struct<s:int,n:int,b:int,k:string>"

    def named(kind: str) -> Column:
        return F.transform(spans[kind], lambda c: F.struct(c["bs"].alias("s"), (-c["be"]).alias("n"), c["be"].alias("b"), F.lit(f"[{kind.upper()}]").alias("k")).cast(item))

    def cut_up(every: Column) -> Column:
        def pieces(raw: Column) -> Column:
            def out(at: Column, c: Column) -> Column:
                between = F.substring(raw, at + 1, c["s"] - at).cast("string")
                return F.when(c["s"] < at, "").otherwise(F.concat(between, c["k"]))

            middle = scan(every, item, F.lit(0), "int", lambda at, c: F.greatest(at, c["b"]), out, "string")
            rest = F.substring(raw, F.array_max(F.transform(every, lambda c: c["b"])) + 1, F.lit(2**31 - 1)).cast("string")
            return F.concat(F.array_join(middle, ""), rest)

        return F.when(F.size(every) == 0, text).otherwise(let(text.cast("binary"), pieces))

    return let(F.array_sort(F.concat(*map(named, KINDS))), cut_up)
