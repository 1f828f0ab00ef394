r"""Operator 9, PII: keyed, type-consistent surrogates.

Detected are e-mail addresses, IPv4 addresses, IBANs, social security numbers,
card numbers (13 to 19 digits, spaces or hyphens between them allowed), phone
numbers and names after a title.  One pattern finds them all, leftmost first,
in that order where two start together.  Each is replaced by a value of its
type made from a secret key, so the same entity has the same surrogate
everywhere (coreference), and different ones have different ones:

* digits of cards and phones go through a four-round Feistel permutation of all
  numbers of their length (SHA-256 with the key), so no two can meet;
  punctuation, a phone's country code and a card's first digit stay.  Another
  punctuation of the same number gives the same digits.  A card's last digit is
  the check digit of the new number, off by as much as the old one was: numbers
  that pass the check stay such, and the others fail it still;
* social security numbers likewise, with numbers of an area, group and serial that are
  issued permuted among themselves, and the others among others of their sort;
* IPv4 addresses likewise, as two 16-bit halves;
* e-mail addresses and IBANs keep their length, punctuation, top-level domain
  or country; letters become letters and digits digits.  An IBAN's check digits
  are made anew, to leave the remainder that the old ones left.  Addresses are read in
  lower case; the domain's surrogate depends on the domain alone;
* names keep title, number of parts, capitals and script (Latin or Cyrillic).  A given name's
  surrogate ends as the title's gender asks; a surname's is the same with and
  without a given name, and under any title.

Collision check: all different entities of the corpus are listed (short keys,
partial sums), and a kind with two entities of one surrogate goes to the next
strength, which appends letters or syllables, until there is none.

The replacement is one projection; no text is shuffled.

Defined cases: null texts stay null, empty ones empty; texts without an entity
stay as they are; repeated rows are treated alike; further columns pass
through unchanged in ``replace`` and are ignored in ``surrogates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FREE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_MALE = "Mr|Sir|Herr|Herrn|Monsieur|Señor|Sr|Don|Господин|господин"
_FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mademoiselle|Mlle|Señora|Sra|Señorita|Srta|Doña|Госпожа|госпожа"
_OPEN = "Dr|Prof|Professor|Doctor|Docteur|Doktor"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_PHONE_END = r"(?:[ .-][0-9]{2,4}){1,3}"

#: Kind and pattern, in order of preference.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\p{{L}}\p{{N}}_.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}_])(?!\.[0-9])",
    "iban": _FREE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "ssn": r"(?<![\p{L}\p{N}_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_-])",
    "card": r"(?<![\p{L}\p{N}_.-])[0-9](?:[ -]?[0-9]){12,18}" + _END,
    "phone": rf"(?<![\p{{L}}\p{{N}}_.])(?:\+[0-9]{{8,15}}|\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}}){_PHONE_END}"
             rf"|\([0-9]{{2,4}}\) ?[0-9]{{2,4}}{_PHONE_END}|[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}){_END}",
    "person": rf"{_FREE}(?:{_MALE}|{_FEMALE}|{_OPEN})\.? {_NAME}(?: {_NAME})?",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without these cannot hold an entity.
_GATE = rf"[0-9@]|{_FREE}(?:{_MALE}|{_FEMALE}|{_OPEN})\.? \p{{Lu}}"

_LATIN = "ba be bi bo da de di do fa fe ga go ka ke ki la le li lo ma me mi mo na ne no ra re ri ro sa te".split()
_CYRILLIC = "ба бе би бо да де ди до фа фе га го ка ке ки ла ле ли ло ма ме ми мо на не но ра ре ри ро са те".split()


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Surrogates:
    """SQL of the surrogate of an entity; ``strength`` by kind of name part."""

    def __init__(self, key: str, strength: dict[str, int] | None = None):
        self.key, self.strength = key, strength or {}

    def _hash(self, *parts: str) -> str:
        """SHA-256 of the key and the parts, as a number below 2^60."""
        return f"cast(conv(substr(sha2(concat_ws('|', {_lit(self.key)}, {', '.join(parts)}), 256), 1, 15), 16, 10) as bigint)"

    def _digits(self, kind: str, digits: str) -> str:
        """A permutation of all digit strings of one length."""
        turn = self._hash(f"'{kind}'", "length(d)", "i", "a.r")
        return f"""transform(array({digits}), d -> if(length(d) < 2, d, aggregate(sequence(1, 4),
            named_struct('l', substr(d, 1, length(d) div 2), 'r', substr(d, length(d) div 2 + 1)),
            (a, i) -> named_struct('l', a.r, 'r', lpad(cast(pmod(cast(a.l as bigint) + {turn},
                cast(pow(10, length(a.l)) as bigint)) as string), length(a.l), '0')), a -> concat(a.l, a.r))))[0]"""

    @staticmethod
    def _into(value: str, digits: str) -> str:
        """``value`` with its digits replaced one after another."""
        return f"""transform(array(named_struct('v', {value}, 's', {digits})), z -> aggregate(split(z.v, ''),
            named_struct('n', 1, 'out', ''), (a, c) -> if(c rlike '^[0-9]$', named_struct('n', a.n + 1, 'out', concat(a.out, substr(z.s, a.n, 1))),
            named_struct('n', a.n, 'out', concat(a.out, c))), a -> a.out))[0]"""

    def _only_digits(self, value: str) -> str:
        return f"regexp_replace({value}, '[^0-9]', '')"

    def _stream(self, kind: str, value: str) -> str:
        return f"sha2(concat_ws('|', {_lit(self.key)}, '{kind}', {value}), 512)"

    def _alike(self, kind: str, value: str, more: int = 0) -> str:
        """Letters to letters, digits to digits, the rest as it is; ``more`` letters are appended."""
        byte = "cast(conv(substr(z.s, 1 + 2 * pmod(i - 1, 64), 2), 16, 10) as int)"
        letter = f"substr('abcdefghijklmnopqrstuvwxyz', 1 + {byte} % 26, 1)"
        return f"""transform(array(named_struct('v', {value}, 's', {self._stream(kind, value)})), z -> array_join(
            transform(sequence(1, length(z.v) + {more}), i -> case when i > length(z.v) then {letter}
            when substr(z.v, i, 1) rlike '^[0-9]$' then cast({byte} % 10 as string)
            when substr(z.v, i, 1) rlike '^[a-z]$' then {letter}
            when substr(z.v, i, 1) rlike '^[A-Z]$' then upper({letter}) else substr(z.v, i, 1) end), ''))[0]"""

    def email(self, v: str) -> str:
        domain = f"substr({v}, instr({v}, '@') + 1)"
        host = f"regexp_extract({domain}, '^(.*)[.]([a-z]+)$', 1)"
        tld = f"regexp_extract({domain}, '^(.*)[.]([a-z]+)$', 2)"
        # Keyed on the whole address, but of the local part's form.
        local = f"substr({self._alike('email', v, 4 * self.strength.get('email', 0))}, 1, instr({v}, '@') - 1)"
        more = self.strength.get("email", 0)
        tail = f"substr({self._alike('tail', v)}, 1, {3 * more})" if more else "''"
        return (f"concat({local}, regexp_replace({tail}, '[^a-z]', 'q'), '@', {self._alike('host', host, 4 * self.strength.get('host', 0))}, '.', {tld})")

    def ip(self, v: str) -> str:
        turn = self._hash("'ip'", "i", "a.r")
        return f"""transform(array(transform(split({v}, '[.]'), o -> cast(o as bigint))), o -> aggregate(sequence(1, 4),
            named_struct('l', o[0] * 256 + o[1], 'r', o[2] * 256 + o[3]),
            (a, i) -> named_struct('l', a.r, 'r', pmod(a.l + {turn}, 65536L)),
            a -> concat_ws('.', a.l div 256, a.l % 256, a.r div 256, a.r % 256)))[0]"""

    @staticmethod
    def _rest97(value: str) -> str:
        """An IBAN modulo 97, with its first four characters behind the others."""
        return f"""aggregate(split(regexp_replace(concat(substr({value}, 5), substr({value}, 1, 4)), ' ', ''), ''), 0, (a, c) -> case
            when c = '' then a when c rlike '^[0-9]$' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end)"""

    def iban(self, v: str) -> str:
        account = self._alike("iban", f"substr({v}, 3)", 4 * self.strength.get("iban", 0))
        open_ = f"concat(substr({v}, 1, 2), '00', upper(substr({account}, 3)))"
        return f"""transform(array({open_}), o -> concat(substr(o, 1, 2),
            lpad(cast(2 + pmod({self._rest97(v)} - {self._rest97('o')} - 2, 97) as string), 2, '0'), substr(o, 5)))[0]"""

    def ssn(self, v: str) -> str:
        """Area, group and serial as places among the numbers of their sort, issued or
        not; area and the two others take turns in being moved."""
        turn = self._hash("'ssn'", "i", "if(i % 2 = 1, a.y, a.x)")
        return f"""transform(transform(transform(array(split({v}, '-')), p -> named_struct('area', cast(p[0] as bigint),
                'group', cast(p[1] as bigint), 'serial', cast(p[2] as bigint))),
            n -> named_struct('issued', n.area not in (0, 666) and n.area < 900, 'groups', if(n.group = 0, 1L, 99L), 'serials', if(n.serial = 0, 1L, 9999L),
                'x', case when n.area = 0 then 0L when n.area = 666 then 1L when n.area >= 900 then n.area - 898 when n.area < 666 then n.area - 1 else n.area - 2 end,
                'y', greatest(n.group - 1, 0L) * if(n.serial = 0, 1L, 9999L) + greatest(n.serial - 1, 0L))),
            m -> aggregate(sequence(1, 4), named_struct('x', m.x, 'y', m.y),
                (a, i) -> if(i % 2 = 1, named_struct('x', pmod(a.x + {turn}, if(m.issued, 898L, 102L)), 'y', a.y),
                    named_struct('x', a.x, 'y', pmod(a.y + {turn}, m.groups * m.serials))),
                a -> concat_ws('-',
                    lpad(cast(case when not m.issued then if(a.x = 0, 0L, if(a.x = 1, 666L, a.x + 898)) when a.x < 665 then a.x + 1 else a.x + 2 end as string), 3, '0'),
                    lpad(cast(if(m.groups = 1, 0L, a.y div m.serials + 1) as string), 2, '0'),
                    lpad(cast(if(m.serials = 1, 0L, a.y % m.serials + 1) as string), 4, '0'))))[0]"""

    @staticmethod
    def _luhn(digits: str) -> str:
        """Weighted sum of the check of ``digits``, the last one a place before the check digit."""
        return f"""aggregate(sequence(1, length({digits})), 0, (a, i) -> transform(array(cast(substr({digits}, -i, 1) as int)),
            g -> a + if(i % 2 = 1, 2 * g - if(g > 4, 9, 0), g))[0])"""

    def card(self, v: str) -> str:
        digits = self._only_digits(v)
        middle = self._digits("card", "substr(w, 2, length(w) - 2)")
        return f"""transform(transform(array({digits}), w -> named_struct('w', w, 'b', concat(substr(w, 1, 1), {middle}))),
            u -> {self._into(v, f"concat(u.b, cast(pmod({self._luhn('substr(u.w, 1, length(u.w) - 1)')} + cast(substr(u.w, -1, 1) as int) - {self._luhn('u.b')}, 10) as string))")})[0]"""

    def phone(self, v: str) -> str:
        country = f"regexp_extract({v}, '^[+][0-9]{{1,3}}(?=[ .(-])', 0)"
        rest = f"substr({v}, 1 + length({country}))"
        return f"concat({country}, {self._into(rest, self._digits('phone', self._only_digits(rest)))})"

    def name(self, kind: str, v: str) -> str:
        """A name of syllables; ``kind``: surname, given_m, given_f, given_x."""
        def made(syllables: list[str], end: str) -> str:
            listed = ", ".join(f"'{s}'" for s in syllables)
            return f"""initcap(concat(array_join(transform(sequence(1, {3 + self.strength.get(kind, 0)}), i ->
                array({listed})[cast(conv(substr({self._stream(kind, f'lower({v})')}, 2 * i - 1, 2), 16, 10) as int) % 32]), ''), '{end}'))"""
        latin, cyrillic = {"surname": ("n", "н"), "given_f": ("a", "а"), "given_m": ("o", "й"), "given_x": ("e", "е")}[kind]
        plain = rf"if({v} rlike '[\\u0400-\\u04FF]', {made(_CYRILLIC, cyrillic)}, {made(_LATIN, latin)})"
        return f"if(upper({v}) = {v}, upper({plain}), {plain})"

    def person(self, v: str) -> str:
        title, first, second = (f"regexp_extract({v}, '^([^ ]+ )([^ ]+)(?: ([^ ]+))?$', {i})" for i in (1, 2, 3))
        given = f"case {' '.join(f'when {test} then {self.name(kind, first)}' for test, kind in _genders(title))} else {self.name('given_x', first)} end"
        return f"if({second} = '', concat({title}, {self.name('surname', first)}), concat({title}, {given}, ' ', {self.name('surname', second)}))"

    def of(self, kind: str, v: str) -> str:
        """SQL of the surrogate of the entity ``v`` (a column or lambda variable)."""
        by_kind = {"email": self.email(f"lower({v})"), "ip": self.ip(v), "iban": self.iban(v), "ssn": self.ssn(v),
                   "card": self.card(v), "phone": self.phone(v), "person": self.person(v)}
        return "case " + " ".join(f"when {kind} = '{k}' then {sql}" for k, sql in by_kind.items()) + f" else {v} end"


def _genders(title: str) -> list[tuple[str, str]]:
    return [(f"{title} rlike {_lit(rf'^(?:{_MALE})[.]? $')}", "given_m"), (f"{title} rlike {_lit(rf'^(?:{_FEMALE})[.]? $')}", "given_f")]


def _kind(v: str) -> str:
    """SQL of the kind of a match: the first pattern that takes all of it."""
    return "case " + " ".join(f"when {v} rlike {_lit(f'^(?:{p})$')} then '{k}'" for k, p in PATTERNS.items()) + " else 'none' end"


def _found(text: Column) -> Column:
    return F.when(text.rlike(_GATE), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Different entities (kind, value) of the corpus as the collision check
    sees them: names by part, addresses in lower case, numbers by digits."""
    found = docs.select(F.explode(_found(F.col(text_col))).alias("v")).groupBy("v").count().select("v", F.expr(_kind("v")).alias("kind"))
    title, first, second = (f"regexp_extract(v, '^([^ ]+ )([^ ]+)(?: ([^ ]+))?$', {i})" for i in (1, 2, 3))
    gender = f"case {' '.join(f'when {t} then {_lit(k)}' for t, k in _genders(title))} else 'given_x' end"
    parts = F.expr(f"""case when kind = 'person' and {second} = '' then array(named_struct('kind', 'surname', 'value', lower({first})))
        when kind = 'person' then array(named_struct('kind', {gender}, 'value', lower({first})), named_struct('kind', 'surname', 'value', lower({second})))
        when kind = 'email' then array(named_struct('kind', kind, 'value', lower(v)),
            named_struct('kind', 'host', 'value', regexp_extract(lower(v), '@(.*)[.][a-z]+$', 1)))
        else array(named_struct('kind', kind, 'value', v)) end""")
    return found.select(F.inline(parts)).distinct()


def collisions(found: DataFrame, made: Surrogates) -> list[str]:
    """Kinds in which two different entities have one surrogate.  Numbers that
    differ in punctuation alone are one entity and differ as surrogates too."""
    names = " ".join(f"when kind = '{k}' then lower({made.name(k, 'value')})" for k in ("surname", "given_m", "given_f", "given_x"))
    host = made._alike("host", "value", 4 * made.strength.get("host", 0))
    surrogate = f"case {names} when kind = 'host' then {host} else {made.of('kind', 'value')} end"
    twice = found.select("kind", F.expr(surrogate).alias("surrogate")).groupBy("kind", "surrogate").count().where("count > 1")
    return [r["kind"] for r in twice.select("kind").distinct().collect()]          # at most one row for each kind


def checked_surrogates(docs: DataFrame, key: str, text_col: str = "text", most_strength: int = 12) -> Surrogates:
    found = staged(entities(docs, text_col), "op9-entities")
    strength: dict[str, int] = {}
    for _ in range(most_strength):
        made = Surrogates(key, dict(strength))
        again = collisions(found, made)
        if not again:
            dropped(found)
            return made
        for kind in again:
            strength[kind] = strength.get(kind, 0) + 1
    raise RuntimeError(f"surrogates still collide: {sorted(strength)}")


def replace(docs: DataFrame, made: Surrogates, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, all other columns as they are."""
    text = F.col(text_col)
    taken = {c.lower() for c in docs.columns}
    pieces, matches = (next(n for n in (f"{stem}{i}" for i in range(99)) if n not in taken) for stem in ("pieces_", "matches_"))
    df = docs.withColumn(matches, _found(text)).withColumn(pieces, F.when(F.size(matches) > 0, F.split(text, _ANY, -1)))
    new = F.expr(f"""concat({pieces}[0], array_join(transform({matches}, (v, n) ->
        concat(transform(array({_kind('v')}), k -> {made.of('k', 'v')})[0], {pieces}[n + 1])), ''))""")
    return df.withColumn(text_col, F.when(F.size(matches) > 0, new).otherwise(text)).select(*docs.columns)


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities and
    kinds (the kind of each entity, in order)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = checked_surrogates(docs, key)
    df = replace(docs.withColumn("kinds", F.coalesce(_found(F.col("text")), F.array().cast("array<string>"))), made)
    return df.select("doc_id", "text", F.size("kinds").cast("long").alias("n_entities"),
                     F.expr(f"transform(kinds, v -> {_kind('v')})").alias("kinds"))
