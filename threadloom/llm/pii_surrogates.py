"""PII: keyed, type-consistent surrogates for e-mail addresses, phones, IPs, numbers and names.

Detection reads whole texts. An entity is made of parts, each with a canonical form:
a lower-cased address, the national digits of a phone, a given name, a family name.
A part's surrogate is made from a keyed hash of type and canonical form, so the same
part has the same surrogate everywhere (coreference): ``Mr Smith``, ``Dr Smith`` and
``John Smith`` share a family name, ``+1 555 123 4567`` and ``555-123-4567`` the
national number. It keeps the format: country codes stay, digits stay digits in their
places, a valid Luhn number or IBAN stays valid, letters keep their script and case, a
given name keeps the gender that it or its title states.

Names are found after a title, after words that announce one, or by a known given name
before a capitalised word. Within a text, a full or titled name binds its words: where
one stands alone later or earlier, capitalised alike, it is the same part.

Distinctness is checked over the whole corpus: parts are counted once, and a part whose
surrogate is already some other part's, or is itself a real part of the corpus, tries
its next attempt until none collides. Later attempts have more room (names more
syllables or a hyphen more, phone numbers and the like more digits, private IPs any
first byte), so that no number of parts uses it up; IPv4 addresses alone cannot grow
past their 212 * 2**24. Persons of different names stay different, as both parts do.

Edge cases: null and empty texts have no entities and pass unchanged; null ids are
allowed; repeated rows are replaced alike; an empty table gives an empty result; columns
named ``entities`` or ``n_entities`` are replaced; a very long text is searched and
rewritten as a whole, others in slices of a batch.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import store
from threadloom.llm.words import slices

KEY = b"threadloom"
#: Attempts in the format of the entity itself; from here on digits are added. Attempts after which IPs are taken for used up.
WIDEN, ATTEMPTS = 8, 256
ENTITY = "array<struct<type:string,start:int,end:int,surrogate:string>>"

_EMAIL = re.compile(r"[^\W_][\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,5}")
_NUMBER = re.compile(
    r"(?<![\w.])(?:(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\w]|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{3,4}[ .-]\d{3,4}(?:[ .-]\d{3,4})?)(?![\w-])"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b)"
    r"|(?P<plus>\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,4})){2,6})(?![\w-])"
)
_BARE = re.compile(r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|ring|telefon|teléfono|téléphone|тел|телефон)\b[^\w+]{1,3}(?:(?:at|no|number|nr|is)\b[^\w+]{1,3})?(\d{7})(?![\w-]|\.\d)")
_FEMALE, _MALE = "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Sra|Señora|Doña|госпожа|г-жа", "Mr|Herr|Monsieur|Sr|Señor|Don|господин|г-н"
_NAME = re.compile(rf"\b(?:(?P<f>{_FEMALE})|(?P<m>{_MALE})|(?P<n>Dr|Prof))\.?[  ](?P<name>[^\W\d_][\w'’-]+(?: [^\W\d_][\w'’-]+)?)")

_GIVEN = {
    ("latin", "f"): "Alice Clara Diana Elena Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Tessa Vera Wilma".split(),
    ("latin", "m"): "Adam Bruno Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Nils Oscar Peter Robert Simon Thomas Viktor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Инна Лидия Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Лев Максим Олег Пётр Юрий".split(),
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Φωτεινή Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Θανάσης Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σπύρος Χρήστος".split(),
    ("armenian", "f"): "Անահիտ Գայանե Եվա Լիլիթ Կարինե Հասմիկ Մարիամ Նարե Նունե Շուշան Սոնա Տաթև".split(),
    ("armenian", "m"): "Արամ Արմեն Գագիկ Դավիթ Կարեն Հակոբ Նարեկ Պետրոս Սարգիս Տիգրան Վահան Րաֆֆի".split(),
}
_FAMILY = {
    "latin": ("Al Ber Cor Dal Els Fen Gar Hol Ing Jor Kel Lin Mar Nor Orm Pel Ros Sten Tor Wen".split(), "berg den feld ham ler man ner sen son stein ton vik".split()),
    "cyrillic": ("Бел Вор Гор Дуб Зим Кар Лаз Мор Нов Ор Пет Рож Сок Тих Федот".split(), "ов ин ский енко ев як".split()),
    "greek": ("Αγγ Βασ Γερ Δημ Ζαχ Θεο Καρ Λαζ Μαν Νικ Παν Ραφ Σταμ Τσακ Φιλ".split(), "ίδης άκης όπουλος άτος έας ούδης".split()),
    "armenian": ("Աբ Բաղ Գրիգ Դան Եղ Զաք Թոր Կար Հով Մար Նազ Պող Սար Տեր Վարդ".split(), "յան ունի ենց ունց".split()),
}
_FULL = re.compile(r"\b([A-ZÀ-ÖØ-ÞА-ЯЁͰ-Ͽ\u0531-\u0556][\w'’-]+)[  ](?=([^\W\d_][\w'’-]+))")
#: Given names that make a capitalised word after them a family name, beside those of the surrogates.
_KNOWN = {
    "f": "Amanda Amy Andrea Angela Anita Ann Anna Anne Barbara Beatriz Brigitte Carla Carmen Carol Catherine Charlotte Chloé Christine Claire Cristina Deborah Elisabeth Elizabeth Emily Emma Eva Françoise "
    "Frieda Hannah Heidi Ingrid Isabel Jane Janet Jennifer Jessica Joan Judith Karen Kate Katharina Laura Lisa Lucía Lucy Margaret Marie Marta Mary Michelle Monika Nancy Nathalie Nicole Olivia Patricia "
    "Petra Rachel Rebecca Sabine Sandra Sarah Sophie Susan Susanne Teresa Ursula Victoria Анастасия Екатерина Ирина Наталья Светлана Татьяна".split(),
    "m": "Alan Alejandro Alexander Andreas Andrew Anthony Antonio Arthur Benjamin Bernd Brian Carlos Charles Christian Christopher Claude Daniel Dieter Diego Edward Eric Ernst Fernando Francisco Frank "
    "François Franz George Günter Hans Henri Henry Jack Jacques James Jan Javier Jean Jeff Joe John Jorge José Joseph Juan Jürgen Kevin Klaus Luis Manuel Marc Mark Martin Matthew Michael Miguel Nicolas "
    "Olivier Otto Pablo Patrick Paul Pedro Philippe Pierre Rafael Ralf Richard Roger Stefan Stephen Steven Tim Tom Walter William Wolfgang Александр Алексей Дмитрий Михаил Николай Сергей".split(),
}
_KNOWN["f"] += "Aisha Ananya Chiara Fatima Giulia Ingeborg Keiko Lakshmi Leila Mei Priya Sakura Yasmin Yuki".split()
_KNOWN["m"] += "Ahmed Ali Amit Arjun Giovanni Giuseppe Hassan Hiroshi Kenji Li Marco Ming Mohamed Mohammed Omar Raj Ravi Wei Yusuf".split()
_ANNOUNCED = re.compile(r"(?i:\b(?:my name is|name:|signed by|signed,|regards,|sincerely,))\s+([A-ZÀ-ÖØ-ÞА-ЯЁͰ-Ͽ\u0531-\u0556][\w'’-]+)[  ]([A-ZÀ-ÖØ-ÞА-ЯЁͰ-Ͽ\u0531-\u0556][\w'’-]+)")
_WORD = re.compile(r"[^\W\d_][^\W_]*(?:['’-][^\W\d_]+)*")
_IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]{7,39}(?![\w:]|\.\d))[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
#: Country codes of two digits; 1 and 7 have one, all others three (fixed values).
_TWO_DIGITS = {20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98}
_GENDER = {n: g for (_, g), names in _GIVEN.items() for n in names} | {n: g for g, names in _KNOWN.items() for n in names}


def _stream(key: bytes, kind: str, norm: str, attempt: int) -> Iterator[int]:
    """Keyed pseudo-random bytes of an entity and attempt."""
    block = 0
    while True:
        yield from hashlib.blake2b(f"{kind}\0{norm}\0{attempt}\0{block}".encode(), key=key[:64], digest_size=64).digest()
        block += 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    """What is left of an IBAN by its check; 1 if it is valid."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


_SCRIPTS = {"cyrillic": re.compile("[Ѐ-ԯ]"), "greek": re.compile("[Ͱ-Ͽἀ-῿]"), "armenian": re.compile("[\u0531-\u0588]")}


def _script(name: str) -> str:
    """The script of a name; what has no pool of its own counts as Latin, so that it is replaced all the same."""
    return next((s for s, letters in _SCRIPTS.items() if letters.search(name)), "latin")


def canonical_surrogate(kind: str, norm: str, attempt: int, key: bytes = KEY) -> str:
    """The canonical form of the surrogate: what :func:`render` writes in the format of an occurrence."""
    rnd = _stream(key, kind, norm, attempt)
    number = lambda n: (next(rnd) << 16 | next(rnd) << 8 | next(rnd)) % n
    if kind == "email":
        local, _, domain = norm.partition("@")
        swap = lambda c: str(number(10)) if c.isdigit() else (chr(ord("а") + number(32)) if "Ѐ" <= c <= "ӿ" else chr(97 + number(26))) if c.isalpha() else c
        top = domain.rpartition(".")[2]
        top = top if top in ("com", "org", "net", "edu") else "net"
        return "".join(map(swap, local)) + f"@{chr(97 + number(26))}{chr(97 + number(26))}{number(10_000):04d}.example.{top}"
    if kind == "ip":
        first = norm.split(".")[0]
        return ".".join([first if first in ("10", "127") and attempt < WIDEN else str(11 + number(212))] + [str(number(256)) for _ in range(3)])
    if kind == "ipv6":
        first = norm[:4]  # local addresses stay local
        groups = [first if first[:2] in ("fe", "fc", "fd") and attempt < WIDEN else f"2{number(4096):03x}"] + [f"{number(65536):04x}" for _ in range(7)]
        return ":".join(groups)
    if kind.startswith("given"):
        _, gender, script = kind.split(":")
        names = _GIVEN[script, gender if gender in "fm" else "fm"[number(2)]]
        return "-".join(names[number(len(names))] for _ in range(max(1, attempt))).casefold()
    if kind.startswith("family"):
        stems, ends = _FAMILY[kind.split(":")[1]]
        more = 1 + max(0, attempt - 1)  # the room grows twentyfold or so with each attempt after the second
        return ("".join(stems[number(len(stems))] for _ in range(1 + more)) + ends[number(len(ends))]).casefold()
    if kind == "iban":
        made = norm[:2] + "".join(str(number(10)) if c.isdigit() else chr(65 + number(26)) for c in norm[2:])
        return f"{made[:2]}{98 - _mod97(made[:2] + '00' + made[4:]):02d}{made[4:]}" if _mod97(norm) == 1 else made
    longer = 0 if kind == "card" else max(0, attempt - WIDEN + 1)
    digits = "".join(str(number(10)) for _ in range(len(norm) + longer))
    if kind == "phone":  # national digits do not begin with a zero
        digits = str(1 + number(9)) + digits[1:]
    if kind == "card" and _luhn(norm):
        digits = next(digits[:-1] + str(d) for d in range(10) if _luhn(digits[:-1] + str(d)))
    return digits


def render(kind: str, shown: str, surrogate: str) -> str:
    """The surrogate in the format of one occurrence: its case, its separators."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(surrogate)
        return "".join([*(next(rest) if c.isalnum() else c for c in shown), *rest])
    if shown.isupper() and not shown.islower():
        return surrogate.upper()
    if kind.startswith(("given", "family")):
        return "-".join(w.upper().capitalize() for w in surrogate.split("-"))  # by way of capitals: a last sigma takes its final form
    if kind == "ipv6":
        return surrogate if "::" not in shown else str(ipaddress.IPv6Address(surrogate))
    return surrogate


def _given(word: str, gender: str = "n") -> tuple[str, str]:
    """Type and canonical form of a given name; its own gender counts before that of a title."""
    return f"given:{_GENDER.get(word, gender)}:{_script(word)}", word.casefold()


def _family(word: str) -> tuple[str, str]:
    return f"family:{_script(word)}", word.casefold()


def _phone(shown: str) -> tuple[int, str]:
    """Where the national digits of a phone begin, and what they are."""
    at = 0
    if shown[0] == "+":
        m = re.match(r"\+(\d{1,3})(?=\D)", shown)
        digits = re.match(r"\+(\d*)", shown)[1]
        at = m.end() if m else 1 + (1 if digits[0] in "17" else 2 if int(digits[:2]) in _TWO_DIGITS else 3)
    while at < len(shown) and shown[at] not in "123456789":  # separators and trunk zeros stay
        at += 1
    return at, "".join(c for c in shown[at:] if c.isdigit())


def _names(text: str) -> list[tuple]:
    """Names after titles, after words that announce them, or by a known given name."""
    out = []

    def add(start: int, words: list[str], gender: str = "n") -> None:
        if len(words) > 1:
            second = start + len(words[0]) + 1
            parts = ((start, start + len(words[0]), *_given(words[0], gender)), (second, second + len(words[1]), *_family(words[1])))
        else:
            parts = ((start, start + len(words[0]), *_family(words[0])),)
        out.append((start, parts[-1][1], "name", parts))

    for m in _FULL.finditer(text):
        if m[1] in _GENDER and m[2][:1].isupper():
            add(m.start(), [m[1], m[2]])
    for m in _ANNOUNCED.finditer(text):
        add(m.start(1), [m[1], m[2]])
    for m in _NAME.finditer(text):
        words = m["name"].split(" ")
        if words[0][:1].isupper():
            add(m.start("name"), words if len(words) > 1 and words[1][:1].isupper() else words[:1], "f" if m["f"] else "m" if m["m"] else "n")
    return out


def find(text: str) -> list[tuple[int, int, str, tuple]]:
    """(start, end, type, parts) of the entities of a text, in order, not overlapping; a part is (start, end, type, canonical form)."""
    out = []
    whole = lambda start, end, kind, norm: out.append((start, end, kind, ((start, end, kind, norm),)))

    def phone(start: int, end: int) -> None:
        at, digits = _phone(text[start:end])
        if len(digits) >= 6 and len([c for c in text[start:end] if c.isdigit()]) in range(7, 16):
            out.append((start, end, "phone", ((start + at, end, "phone", digits),)))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            whole(m.start(), m.end(), "email", m[0].casefold())
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if m.lastgroup in ("phone", "plus"):
                phone(m.start(), m.end())
            else:
                whole(m.start(), m.end(), m.lastgroup, m[0] if m.lastgroup == "ip" else "".join(c for c in m[0] if c.isalnum()))
        if _SEVEN.search(text):
            for m in _BARE.finditer(text):
                phone(m.start(1), m.end(1))
        for m in _IPV6.finditer(text) if text.count(":") > 1 else ():
            try:
                norm = ipaddress.IPv6Address(m[0]).exploded
            except ValueError:
                continue
            if sum(map(bool, m[0].split(":"))) > 2 and _DIGIT.search(m[0]):
                whole(m.start(), m.end(), "ipv6", norm)
    names = _names(text)
    if names:  # their words alone are the same persons
        bound: dict[str, tuple] = {}
        for _, _, _, parts in names:
            for start, end, kind, norm in parts:
                if end - start > 2:
                    bound.setdefault(text[start:end], (kind, norm))
        for m in _WORD.finditer(text):
            word = m[0] if m[0] in bound else m[0][:-2] if m[0][-2:] in ("'s", "’s") and m[0][:-2] in bound else None
            if word:
                start, end = m.start(), m.start() + len(word)
                out.append((start, end, "name", ((start, end, *bound[word]),)))
        out += names
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, end = [], 0
    for x in out:
        if x[0] >= end:
            kept.append(x)
            end = x[1]
    return kept


_DIGIT, _SEVEN = re.compile("[0-9]"), re.compile("[0-9]{7}")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, type, norm): the distinct parts of each text (th, text)."""
    for batch in batches:
        for part in slices(batch, batch.schema.names[1]):
            rows = [(h, k, n) for h, t in zip(*[c.to_pylist() for c in part.columns]) if t for k, n in {(x[2], x[3]) for e in find(t) for x in e[3]}]
            yield pa.RecordBatch.from_pydict({"th": pa.array([x[0] for x in rows], pa.int64()), "type": pa.array([x[1] for x in rows], pa.string()), "norm": pa.array([x[2] for x in rows], pa.string())})


def exceptions(entities: DataFrame, key: bytes = KEY) -> DataFrame | None:
    """(type, norm, attempt) of the entities whose first surrogate collides; None when there are none.

    ``entities``: distinct (type, norm). Collisions are judged within a family
    of types that look alike: all names are one family."""
    family = F.substring_index("type", ":", 1)

    def made(attempt: int):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds, norms = b.column(0).to_pylist(), b.column(1).to_pylist()
                yield pa.RecordBatch.from_pydict({"type": b.column(0), "norm": b.column(1), "surrogate": pa.array([canonical_surrogate(k, n, attempt, key) for k, n in zip(kinds, norms)], pa.string())})

        return make

    schema = "type string, norm string, surrogate string"
    real = entities.select(family.alias("family"), F.col("norm").alias("surrogate")).distinct()
    pending, taken, out = entities, None, None
    for attempt in range(ATTEMPTS):
        tried = store.table(pending.select("type", "norm").mapInArrow(made(attempt), schema).withColumn("family", family), "surrogates")
        winner = tried.groupBy("family", "surrogate").agg(F.min(F.struct("norm", "type")).alias("first"))
        free = winner.join(real, ["family", "surrogate"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["family", "surrogate"], "left_anti")
        won = store.table(free.select("family", "surrogate", F.col("first.type").alias("type"), F.col("first.norm").alias("norm")), "surrogates")
        if attempt:
            done = won.select("type", "norm", F.lit(attempt).alias("attempt"))
            out = done if out is None else out.unionByName(done)
        pending = tried.join(won, ["type", "norm"], "left_anti").select("type", "norm")
        taken = won.select("family", "surrogate") if taken is None else taken.unionByName(won.select("family", "surrogate"))
        if pending.isEmpty():
            return out
    raise ValueError("the corpus holds more distinct IPs than surrogates can be found for")


def replace(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, key: bytes = KEY) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``entities`` (type, start, end in the old text, surrogate) and ``n_entities`` added."""
    held = store.table(docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("t")).mapInArrow(_held, "th long, type string, norm string"), "parts")
    again = exceptions(held.select("type", "norm").distinct(), key)
    rows = docs.drop("entities", "n_entities")
    keep = rows.columns
    if again is None:
        rows = rows.withColumn("__tl_again", F.lit(None).cast("array<struct<type:string,norm:string,attempt:int>>"))
    else:  # the attempts of a text's parts that collided
        lists = held.join(again, ["type", "norm"]).groupBy(F.col("th").alias("__th")).agg(F.collect_set(F.struct("type", "norm", "attempt")).alias("__tl_again"))
        rows = rows.join(lists, F.xxhash64(text) == F.col("__th"), "left").drop("__th")
    fields = [rows.schema[c] for c in keep] + [T.StructField("entities", T._parse_datatype_string(ENTITY)), T.StructField("n_entities", T.LongType())]
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def rewritten(t: str, attempts: dict) -> tuple[list[dict], str]:
        spans, out, at = [], [], 0
        for start, end, what, parts in find(t):
            new, here = [], start
            for a, b, k, norm in parts:
                new += [t[here:a], render(k, t[a:b], canonical_surrogate(k, norm, attempts.get((k, norm), 0), key))]
                here = b
            new = "".join([*new, t[here:end]])
            spans.append({"type": what, "start": start, "end": end, "surrogate": new})
            out += [t[at:start], new]
            at = end
        return spans, "".join([*out, t[at:]])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, text):
                texts, found = b.column(keep.index(text)).to_pylist(), []
                for i, (t, other) in enumerate(zip(texts, b.column(len(keep)).to_pylist())):
                    spans, new = rewritten(t, {(x["type"], x["norm"]): x["attempt"] for x in other or ()}) if t else ([], t)
                    found.append(spans)
                    texts[i] = new
                columns = [pa.array(texts, pa.string()) if c == text else b.column(j) for j, c in enumerate(keep)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind), pa.array([len(x) for x in found], pa.int64())], [*keep, "entities", "n_entities"])

    return rows.mapInArrow(rewrite, T.StructType(fields))
