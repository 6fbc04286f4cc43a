"""Personal data replaced by keyed surrogates of the same kind.

Every detected entity has a kind and a canonical value, so spellings of one thing agree. A
surrogate is drawn from a keyed hash of both: digits stay digits in the same layout, card and
account numbers keep their check sums, names keep their gender, script and case. The distinct
values of all texts are drawn in rounds: a surrogate that is itself somebody's value, or that two values
claim, is drawn again by all but one, until none collide. Where a space of numbers is nearly used up, such as that of
192.168.0.0/16, a keyed permutation of it without fixed points is taken instead. So equal values get equal surrogates
in every text, and different values different ones. Each text is scanned once.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..plans.shared import materialize, new_path, temporary
from .batches import fresh_name, text_slices

#: Draws of a value at most; in the second half a surrogate may be another's value.
ROUNDS = 64
#: A space of which more than one in so many numbers is somebody's is permuted instead of drawn from.
DENSE = 16

_EMAIL = re.compile(r"(?<![\w.+%-])[\w+%-]+(?:\.[\w+%-]+)*@(?:[\w-]+\.)+[^\W\d_]{2,}(?![\w-])")
_ID = re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)")
_CARD = re.compile(r"\d(?:[ -]?\d){12,}")
_BEFORE, _AFTER = re.compile(r"(?<![\w.+-])"), re.compile(r"(?![\w-]|\.\d)")
# How card numbers are printed, by the digits of their groups.
_LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (16,), (15,), (14,), (19,)}
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)")
_PHONE = re.compile(
    r"(?<![\w+.-])(?:(?:\+\d{1,3}|00\d{1,3})(?:[ .-]?\(0\))?(?:[ .-]?\(\d{1,4}\)|[ .-]\d{1,5}|\d{4,12})(?:[ .-]?\d{2,5}){0,5}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3,4}\1\d{4}|0\d([ .-])\d{2}(?:\2\d{2}){3}|0\d{2,4}[ -]\d{6,8})(?![\w]|-\d|\.\d)"
)
# The country codes of two digits; 1 and 7 are codes of one digit, all others have three.
_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NORTH_AMERICAN = re.compile(r"\(?[2-9]\d{2}[). .-]*[2-9]\d{2}[ .-]\d{4}")
_IBAN = re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")
# Forms of address by gender, and phrases that a name follows.
_MALE = r"Mr|Mister|Herrn?|Monsieur|Señor|Signor|Sr|господин|г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Signora|Sra|госпожа|г-жа"
_EITHER = r"Dr|Prof|Professor"
_INTRO = r"[Mm]y name is|[Jj]e m['’]appelle|[Mm]ein Name ist|[Ii]ch heiße|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут|[Ff]ull name:|이름:|성명:|姓名[:：]"
_WORD = r"(?:(?:[A-ZÀ-ÖØ-Þ]['’])?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*(?:[-'’](?!s(?!\w))[A-ZÀ-ÖØ-Þa-zß-öø-ÿ]+)*|[A-ZÀ-ÖØ-Þ]{2,}|[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?)"
_NAME = re.compile(rf"(?<!\w)(?:(?P<m>{_MALE})|(?P<f>{_FEMALE})|(?P<n>{_EITHER})|(?P<i>{_INTRO}))(?:\.|(?<=:)|(?<=：)|(?=\s)) ?(?P<name>{_WORD}(?: {_WORD}){{0,2}}|[가-힣]{{2,4}}|[一-鿿]{{2,4}})")
_CUE = re.compile(rf"(?<!\w)(?:{_MALE}|{_FEMALE}|{_EITHER}|{_INTRO})")
# Given names that tell the gender where the address doesn't.
_GIVEN = {
    "f": "anna maria emma laura julia sarah jane mary emily alice claire sophie marie camille lucía carmen elena sofía linda susan karen nancy lisa betty helen sandra donna carol ruth sharon michelle amanda melissa rebecca deborah katharina ursula monika petra sabine heike nicole isabelle chantal nathalie pilar dolores rosa paula giulia chiara francesca анна мария ольга елена наталья татьяна ирина светлана",
    "m": "john james peter paul thomas michael david robert daniel hans karl jürgen pierre jean louis carlos juan josé miguel william richard joseph charles christopher matthew anthony mark steven andrew kenneth george edward brian kevin ronald klaus wolfgang stefan andreas uwe dieter jacques michel philippe nicolas antonio francisco manuel javier luca marco giovanni иван сергей пётр павел александр дмитрий андрей николай",
}
_GENDER = {w: g for g, names in _GIVEN.items() for w in names.split()}
# Syllables and endings that names of a script are made of.
_SYLLABLES = {
    "Latn": ("ba be bo bra ca co da do fe fi ga gre ha he il ja ka ke la le lo ma me mi na ne no pa ra re ri ro sa se so ta te ti va ve vi wa we za".split(), {"f": "ria lena dina sia mila".split(), "m": "ton bert rik mund dor".split(), "n": "lin ren vis kim sol".split(), "": "mann ley rez son ford vall dorf ert".split()}),
    "Cyrl": ("ба ва га да до ла ли ма ми на но па ра ро са та ти во".split(), {"f": "рина лия дана".split(), "m": "слав мир дор".split(), "n": "лин сим".split(), "": "енко ский дин тов".split()}),
    "Hang": ("가 나 다 라 마 바 사 아 자 차 하 민 서 지 현 준 은 영".split(), {"f": "희 숙 아".split(), "m": "철 호 석".split(), "n": "진 윤".split(), "": "김 이 박 최".split()}),
    "Hani": ("安 博 成 德 恩 方 高 海 嘉 凯 林 明".split(), {"f": "娟 丽 芳".split(), "m": "强 伟 军".split(), "n": "文 宁".split(), "": "王 李 张 陈".split()}),
}
_RESERVED = re.compile(r"(?:^|\.)(?:example(?:\.(?:com|net|org))?|invalid|test|localhost)$")


def _luhn(digits: str) -> int:
    """The check digit of a card number without its last digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account)) % 97


def _script(word: str) -> str:
    c = word[0]
    return "Hang" if "가" <= c <= "힣" else "Hani" if "一" <= c <= "鿿" else "Cyrl" if "Ѐ" <= c <= "ӿ" else "Latn"


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Parts of introduced or addressed names, and the other places of the same parts in the text."""
    found, parts = [], {}
    for m in _NAME.finditer(text):
        at, words = m.start("name"), m["name"].split(" ")
        gender = "m" if m["m"] else "f" if m["f"] else _GENDER.get(words[0].casefold(), "n")
        for i, w in enumerate(words):
            last = i == len(words) - 1 and (len(words) > 1 or not m["i"])
            kind = f"{'surname' if last else 'given'}.{'' if last else gender}.{_script(w)}"
            parts.setdefault(w, kind)
            found.append((at, at + len(w), kind, w.casefold()))
            at += len(w) + 1
    if parts:
        again = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, parts), key=len, reverse=True)) + r")(?!\w)")
        found += [(m.start(), m.end(), parts[m.group()], m.group().casefold()) for m in again.finditer(text)]
    return found


def _cards(text: str, a: int, b: int) -> list[tuple[int, int, str, str]]:
    """Card numbers among the groups of a run of digits: other numbers may stand before, between and after them.

    Of overlapping ones those in a usual layout win, then the earlier and the longer.
    """
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", text[a:b])]
    fit = []
    for i, (start, _) in enumerate(groups):
        if i == 0 and not _BEFORE.match(text, a):
            continue
        digits, layout = "", ()
        for j, (x, y) in enumerate(groups[i:], i):
            digits += text[a + x : a + y]
            layout += (y - x,)
            if len(digits) > 19:
                break
            if len(digits) >= 13 and (j < len(groups) - 1 or _AFTER.match(text, b)) and int(digits[-1]) == _luhn(digits[:-1]) and digits.strip("0"):
                fit.append((layout not in _LAYOUTS, a + start, -(a + y), digits))
    found: list[tuple[int, int, str, str]] = []
    for _, start, end, digits in sorted(fit):
        if all(-end <= x or start >= y for x, y, *_ in found):
            found.append((start, -end, "card", digits))
    return found


def _dialled(mention: str) -> list[int]:
    """Where the digits of a phone number are that belong to it, without the prefix for calls abroad and a zero that is left out then."""
    places = [m.start() for m in re.finditer(r"\d", mention)]
    if mention.startswith("00"):
        places = places[2:]
    return [i for i in places if mention[i - 1 : i + 2] != "(0)"]


def _phone(mention: str) -> tuple[str, str]:
    """Kind and canonical value of a phone number: country code and number wherever the country can be told, so that all spellings agree."""
    digits = "".join(mention[i] for i in _dialled(mention))
    if mention.startswith(("+", "00")):
        return f"phone+{digits[: 1 if digits[0] in '17' else 2 if digits[:2] in _CODES else 3]}", digits
    if _NORTH_AMERICAN.fullmatch(mention):
        return "phone+1", f"1{digits}"
    return "phone", digits


def find_entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of the personal data in a text, in order, without overlaps; the earlier and then the longer wins."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m.group().lower()) for m in _EMAIL.finditer(text)]
    for m in _digit_places(text):
        a, b = m
        for s in _ID.finditer(text, a, b):
            found.append((s.start(), s.end(), "id", re.sub(r"\D", "", s.group())))
        for s in _CARD.finditer(text, a, b):
            found += _cards(text, s.start(), s.end())
        for s in _IP.finditer(text, a, b):
            octets = [int(x) for x in s.group().split(".")]
            if max(octets) <= 255:
                found.append((s.start(), s.end(), "ip", ".".join(map(str, octets))))
        for s in _PHONE.finditer(text, a, b):
            if 8 <= len(re.sub(r"\D", "", s.group())) <= 16:
                found.append((s.start(), s.end(), *_phone(s.group())))
        for s in _IBAN.finditer(text, max(0, a - 2), b):
            account = s.group().replace(" ", "")
            if 15 <= len(account) <= 34 and _mod97(account[4:] + account[:4]) == 1:
                found.append((s.start(), s.end(), "iban", account))
    if "::" in text or text.count(":") > 6:
        for s in _IPV6.finditer(text):
            # two words around a double colon are no address
            if len(s.group().replace("::", ":").strip(":").split(":")) > 2 and any(c.isdigit() for c in s.group()):
                found.append((s.start(), s.end(), "inet", ipaddress.IPv6Address(s.group()).exploded))
    if _CUE.search(text):
        found += _names(text)
    found.sort(key=lambda x: (x[0], -x[1], x[2]))
    out, end = [], 0
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


_RUN = re.compile(r"[+(]{0,2}\d[\d().: +A-Z-]{6,}")


def _digit_places(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that a number of seven characters or more may lie in."""
    for m in _RUN.finditer(text):
        yield m.start(), m.end()


class _Draw:
    """Numbers from a keyed hash of what a surrogate is drawn for."""

    def __init__(self, key: bytes, *what: object) -> None:
        self.key, self.seed, self.block, self.pool = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        got, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return got % n

    def alike(self, c: str) -> str:
        """A character of the same class."""
        if "0" <= c <= "9":
            return str(self.below(10))
        if c.isalpha():
            script = "абвгдежзиклмнопрстуфхцчшэюя" if "Ѐ" <= c <= "ӿ" else "abcdefghijklmnopqrstuvwxyz"
            got = script[self.below(len(script))]
            return got.upper() if c.isupper() else got
        return c


def _digits(draw: _Draw, digits: str, keep: int = 0) -> str:
    """As many digits; the first `keep` stay, and the first drawn is 2 to 9 unless it was 0 or 1."""
    out = digits[:keep]
    for i, c in enumerate(digits[keep:]):
        out += str(2 + draw.below(8)) if i == 0 and c > "1" else str(draw.below(10)) if i else c if c < "2" else str(2 + draw.below(8))
    return out


def draw_surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate of a canonical value at its `attempt`-th draw, itself canonical."""
    draw = _Draw(key, kind, value, attempt)
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        if not _RESERVED.search(domain):
            # a domain is drawn by itself, so that colleagues stay colleagues; the top label is a reserved one
            own = _Draw(key, "domain", domain)
            domain = "".join(own.alike(c) for c in domain.rsplit(".", 1)[0]) + ".example"
        stretch = "" if attempt < 8 else "".join(draw.alike("a") for _ in range(attempt // 8))
        return "".join(draw.alike(c) for c in local) + stretch + "@" + domain
    if kind == "card":
        body = _digits(draw, value[:-1], 1)
        return body + str(_luhn(body))
    if kind == "ip":
        own = ipaddress.IPv4Address(value)
        first = value.split(".")[0]
        if own.is_private:
            return f"{first}.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}" if first == "10" else ".".join([*value.split(".")[:2], str(draw.below(256)), str(1 + draw.below(254))])
        while ipaddress.IPv4Address(got := f"{1 + draw.below(223)}.{draw.below(256)}.{draw.below(256)}.{1 + draw.below(254)}").is_private:
            pass
        return got
    if kind == "inet":
        # fixed value: the prefix for documentation
        return ipaddress.IPv6Address((0x20010DB8 << 96) + (draw.below(1 << 48) << 48) + draw.below(1 << 48)).exploded
    if kind == "iban":
        body = "".join(draw.alike(c) for c in value[4:])
        return f"{value[:2]}{98 - _mod97(body + value[:2] + '00'):02d}{body}"
    if kind.startswith("phone"):
        return _digits(draw, value, len(kind) - len("phone+") if "+" in kind else 0)
    if kind == "id":
        return "".join(str(draw.below(10)) for _ in value)
    role, gender, script = kind.split(".")
    syllables, endings = _SYLLABLES[script]
    size = 1 + (attempt >= 2) + (attempt >= 6) + attempt // 12
    stem = "".join(syllables[draw.below(len(syllables))] for _ in range(size))
    tail = endings[gender if role == "given" else ""]
    tail = tail[draw.below(len(tail))]
    return tail + stem if script in ("Hang", "Hani") and role == "surname" else stem + tail


def render(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate in the layout and case of a mention."""
    if kind.startswith("phone"):
        # a mention without country code has the last digits only
        places = _dialled(mention)
        new = dict(zip(places, surrogate[len(surrogate) - len(places) :], strict=True))
        return "".join(new.get(i, c) for i, c in enumerate(mention))
    if kind == "email":
        if mention.isupper():
            return surrogate.upper()
        local = "".join(c.upper() if m.isupper() else c for m, c in zip(mention.split("@")[0], surrogate, strict=False) if c != "@")
        return local + surrogate[len(local) :]
    if kind.startswith(("card", "id", "iban")):
        rest = iter(surrogate)
        return "".join(next(rest) if c.isalnum() else c for c in mention)
    if kind == "ip":
        return surrogate
    if kind == "inet":
        own = ipaddress.IPv6Address(surrogate)
        text = own.compressed if "::" in mention else ":".join(format(int(x, 16), "x") for x in own.exploded.split(":"))
        return text.upper() if mention.upper() == mention and mention.lower() != mention else text
    return surrogate.upper() if len(mention) > 1 and mention.isupper() else surrogate.title() if mention[:1].isupper() else surrogate


def space(kind: str, value: str) -> tuple[str, int, int]:
    """The space of numbers that a value's surrogates come from, its size, and the value's index; size 0 where there is no bound."""
    if kind == "ip":
        own = ipaddress.IPv4Address(value)
        if own.is_private:
            kept = 1 if value.startswith("10.") else 2
            return "ip " + ".".join(value.split(".")[:kept]), 256 ** (4 - kept), int(own) % 256 ** (4 - kept)
    if kind == "id":
        return kind, 10**9, int(value)
    if kind == "card":
        return f"card {len(value)} {value[0]}", 10 ** (len(value) - 2), int(value[1:-1])
    if kind.startswith("phone"):
        keep = len(kind) - len("phone+") if "+" in kind else 0
        rest = value[keep:]
        low = rest[:1] < "2"
        lead = value[: keep + 1] if low else value[:keep]
        size = 10 ** (len(rest) - 1) if low else 8 * 10 ** (len(rest) - 1)
        return f"{kind} {len(value)} {lead}", size, int(rest[1:] or "0") if low else int(rest) - 2 * 10 ** (len(rest) - 1)
    return "", 0, 0


def _at(kind: str, value: str, index: int) -> str:
    """The number with that index in the space of `value`."""
    if kind == "ip":
        kept = 1 if value.startswith("10.") else 2
        return str(ipaddress.IPv4Address(int(ipaddress.IPv4Address(value)) // 256 ** (4 - kept) * 256 ** (4 - kept) + index))
    if kind == "id":
        return f"{index:09d}"
    if kind == "card":
        body = value[0] + str(index).zfill(len(value) - 2)
        return body + str(_luhn(body))
    keep = len(kind) - len("phone+") if "+" in kind else 0
    rest = value[keep:]
    return value[: keep + 1] + (str(index).zfill(len(rest) - 1) if len(rest) > 1 else "") if rest[:1] < "2" else value[:keep] + str(index + 2 * 10 ** (len(rest) - 1))


class _Permutation:
    """A keyed permutation of 0 ... n-1: a Feistel network over the next even number of bits, walked on until it is back in range."""

    def __init__(self, key: bytes, name: str, n: int) -> None:
        self.key, self.name, self.n = key, name.encode(), n
        self.half = max(1, -(-(n - 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1

    def _round(self, i: int, x: int) -> int:
        got = hmac.new(self.key, b"%s\x1f%d\x1f%d" % (self.name, i, x), hashlib.sha256).digest()
        return int.from_bytes(got[:8], "big") & self.mask

    def _walk(self, x: int, rounds: range) -> int:
        while True:
            left, right = x >> self.half, x & self.mask
            for i in rounds:
                if rounds.step > 0:
                    left, right = right, left ^ self._round(i, right)
                else:
                    left, right = right ^ self._round(i, left), left
            x = left << self.half | right
            if x < self.n:
                return x

    def next(self, x: int) -> int:
        """The number after x on one cycle through all n: never x itself if n > 1, and different for different x."""
        return self._walk((self._walk(x, range(8)) + 1) % self.n, range(7, -1, -1))


def replace_entities(text: str, spans: list[tuple[int, int, str, str]], surrogates: dict[tuple[str, str], str]) -> str:
    """The text with every entity rendered as its surrogate."""
    out, at = [], 0
    for start, end, kind, value in spans:
        out += [text[at:start], render(kind, text[start:end], surrogates[kind, value])]
        at = end
    return "".join([*out, text[at:]])


def _mapped(values: DataFrame, name: str, kind: str, make) -> DataFrame:
    """`values` (kind, value) with a column made from both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(k, v) for k, v in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("value"), pa.array(made, {"string": pa.string()}.get(kind) or pa.struct([("space", pa.string()), ("size", pa.int64())]))], names=["kind", "value", name])

    return values.select("kind", "value").mapInArrow(run, f"kind string, value string, {name} {kind}")


def assign(values: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """kind, value, surrogate for every row of `values` (kind, value; distinct, from a written table).

    Of the values that claim one surrogate the smallest keeps it. Kinds that differ in gender or
    script alone share one space. A space of numbers of which more than one in DENSE is a value is permuted as a whole.
    """
    family = lambda c: F.regexp_extract(c, r"^[a-z]+", 0)
    spaces = _mapped(values, "own", "struct<space:string,size:bigint>", lambda k, v: dict(zip(("space", "size"), (x := space(k, v))[:1] + (min(x[1], 1 << 62),), strict=True))).select("kind", "value", "own.space", "own.size").where("size > 0")
    dense = materialize(spaces.groupBy("space", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * DENSE > F.col("size")), "dense")
    done: DataFrame | None = None
    pending = values
    if not dense.isEmpty():
        full = materialize(spaces.join(dense.select("space", "size"), ["space", "size"]).select("kind", "value"), "dense-values")

        def permuted(kind: str, value: str) -> str:
            name, size, index = space(kind, value)
            return _at(kind, value, _Permutation(key, name, size).next(index))

        done = materialize(_mapped(full, "surrogate", "string", permuted).withColumn("family", family(F.col("kind"))), "surrogates")
        pending = materialize(values.join(full, ["kind", "value"], "left_anti"), "pending")
    originals = values.select(family(F.col("kind")).alias("family"), F.col("value").alias("surrogate"))
    for attempt in range(rounds):
        claims = materialize(_mapped(pending, "surrogate", "string", lambda k, v, a=attempt: draw_surrogate(key, k, v, a)).withColumn("family", family(F.col("kind"))), "claims")
        taken = originals if attempt < rounds // 2 else None
        if done is not None:
            held = done.select("family", "surrogate")
            taken = held if taken is None else taken.unionByName(held)
        free = claims if taken is None else claims.join(taken, ["family", "surrogate"], "left_anti")
        won = free.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "value")).alias("owner")).select("owner.kind", "owner.value", "surrogate", "family")
        won = materialize(won, "surrogates")
        done = won if done is None else done.unionByName(won)
        pending = materialize(pending.join(won, ["kind", "value"], "left_anti").select("kind", "value"), "pending")
        if pending.isEmpty():
            return done.select("kind", "value", "surrogate")
    raise ValueError(f"no distinct surrogates were found for {pending.select('kind').distinct().limit(5).collect()}")


_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType()), StructField("value", StringType())])


def _scanned(docs: DataFrame, row: str, spans: str) -> DataFrame:
    """The rows of `docs` with the personal data found in each, and a number of their own."""
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for part in text_slices(batches):
            found = [[dict(zip(("start", "end", "kind", "value"), x, strict=True)) for x in find_entities(t)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(range(number, number + part.num_rows), pa.int64()), pa.array(found, arrow)], names=[*part.schema.names, row, spans])
            number += part.num_rows

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(row, LongType()), StructField(spans, ArrayType(_SPAN))]))


def pseudonymize(docs: DataFrame, key: bytes, count: str = "n_entities", kinds: str = "kinds") -> DataFrame:
    """All columns of `docs` (among them text) with personal data in text replaced, and the number of entities and their kinds.

    Rows without any, null and empty texts among them, come back as they are; repeated rows get equal
    texts; an empty table gives no rows. Equal values have equal surrogates and different ones different, over the whole table and for one `key`, which
    should be secret. Columns named `count` or `kinds` are replaced.
    """
    docs = docs.drop(count, kinds)
    row, spans, pairs = (fresh_name(docs, x) for x in ("row", "spans", "pairs"))
    found, end = materialize(_scanned(docs, row, spans), "scanned"), new_path(docs.sparkSession, "pairs")
    own_columns, some = docs.columns, F.size(F.col(f"`{spans}`")) > 0
    with temporary(docs.sparkSession):
        each = found.where(some).select(F.col(f"`{row}`").alias("row"), F.explode(F.array_distinct(F.transform(f"`{spans}`", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"))))).alias("e")).select("row", "e.kind", "e.value")
        values = materialize(each.select("kind", "value").distinct(), "values")
        lists = each.join(assign(values, key), ["kind", "value"]).groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(pairs))
        lists = materialize(lists, "pairs", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts, numbers, names = [], [], []
            for text, where, own in zip(part.column("text").to_pylist(), part.column(spans).to_pylist(), part.column(pairs).to_pylist(), strict=True):
                where = [(x["start"], x["end"], x["kind"], x["value"]) for x in where]
                texts.append(replace_entities(text, where, {(x["kind"], x["value"]): x["surrogate"] for x in own}))
                numbers.append(len(where))
                names.append(",".join(sorted({_plain(k) for _, _, k, _ in where})))
            columns = [pa.array(texts, part.schema.field("text").type) if c == "text" else part.column(c) for c in own_columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64()), pa.array(names, pa.string())], names=[*own_columns, count, kinds])

    schema = StructType([*docs.schema.fields, StructField(count, LongType()), StructField(kinds, StringType())])
    changed = found.where(some).join(lists, row).drop(row).mapInArrow(run, schema)
    clean = found.where(~some).select(*[F.col(f"`{c}`") for c in own_columns], F.lit(0).cast("long").alias(count), F.lit("").alias(kinds))
    return changed.unionByName(clean)


@lru_cache(maxsize=4096)
def _plain(kind: str) -> str:
    """The kind without its country code, gender and script."""
    return "name" if kind.startswith(("given", "surname")) else "ip" if kind == "inet" else re.match(r"[a-z]+", kind)[0]
