"""Rules over texts, generated from lexicons as Column expressions; no shuffle, no Python at run time."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import lexicons as L
from lodestone.functions import text as T


def pattern(p: str) -> str:
    """Without regard to case, with word boundaries that know all letters."""
    return f"(?iU){p}"


#: Patterns that are a choice of single words.
_SINGLE_WORDS = re.compile(r"\\b\(([A-Za-z|]+)\)\\b")


def _parted(patterns: list[str]) -> tuple[Counter, list[str]]:
    """Single words with the patterns that name them, and the patterns that are not a choice of such."""
    found = [_SINGLE_WORDS.fullmatch(p) for p in patterns]
    words = Counter(w for m in found if m for w in {*m[1].lower().split("|")})
    return words, [p for m, p in zip(found, patterns, strict=True) if not m]


def _with_words(text: Column, f) -> Column:
    """f(text, words), both worked out once: the words are those between word boundaries, in lower case, two letters replaced by those that they match without regard to case."""
    words = F.split(F.translate(F.lower(text), "\u017f\u0131", "si"), r"(?U)\W+")
    return F.get(F.transform(F.array(F.struct(text.alias("text"), words.alias("words"))), lambda b: f(b["text"], b["words"])), F.lit(0))


def _any(text: Column, words: Column, patterns: list[str]) -> Column:
    single, others = _parted(patterns)
    tests = [F.arrays_overlap(words, F.array(*map(F.lit, sorted(single))))] if single else []
    tests += [text.rlike(pattern("|".join(f"(?:{p})" for p in others)))] if others else []
    return tests[0] | tests[1] if len(tests) > 1 else tests[0]


def _count(text: Column, words: Column, patterns: list[str]) -> Column:
    single, others = _parted(patterns)
    total = F.lit(0)
    for times in sorted({*single.values()}):
        chosen = sorted(w for w, n in single.items() if n == times)
        total = total + times * F.size(F.filter(words, lambda w: w.isin(chosen)))
    for p in others:
        total = total + F.regexp_count(text, F.lit(pattern(p)))
    return total


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def any_match(text: Column, patterns: list[str]) -> Column:
    return _with_words(text, lambda t, ws: _any(t, ws, patterns))


def hits(text: Column, patterns: list[str]) -> Column:
    """Matches of all patterns together: single words are counted among the words of the text, other patterns searched for."""
    return _with_words(text, lambda t, ws: _count(t, ws, patterns))


def class_counts(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """array<struct<n, ordinal, class>>, most matches first, then in order of declaration; classes without a match are left out."""

    def items(t: Column, ws: Column) -> Column:
        return F.array(*[F.struct((-_count(t, ws, ps)).alias("minus"), F.lit(i).alias("ordinal"), F.lit(c).alias("class")) for i, (c, ps) in enumerate(lexicon.items())])

    found = F.array_sort(F.filter(_with_words(text, items), lambda x: x["minus"] < 0))
    return F.transform(found, lambda x: F.struct((-x["minus"]).alias("n"), x["ordinal"].alias("ordinal"), x["class"].alias("class")))


def ranked_classes(text: Column, lexicon: dict[str, list[str]], default: str | None = None) -> Column:
    names = F.transform(class_counts(text, lexicon), lambda x: x["class"])
    return names if default is None else F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


def top_class(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """The class with most matches, the first declared of equals; null without a match."""
    return F.get(ranked_classes(text, lexicon), F.lit(0))


def first_class(text: Column, lexicon: dict[str, list[str]], default: str | None = None) -> Column:
    """The first declared class that matches."""
    return _with_words(text, lambda t, ws: F.coalesce(*[F.when(_any(t, ws, ps), F.lit(c)) for c, ps in lexicon.items()], F.lit(default)))


def matched_classes(text: Column, lexicon: dict[str, list[str]], default: str | None = None) -> Column:
    """All classes that match, in order of declaration."""
    found = F.filter(_with_words(text, lambda t, ws: F.array(*[F.when(_any(t, ws, ps), F.lit(c)) for c, ps in lexicon.items()])), lambda x: x.isNotNull())
    return found if default is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def pattern_hits(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """array<struct<class, pattern>>: of each class that matches, its first pattern that does."""
    firsts = [F.coalesce(*[F.when(text.rlike(pattern(p)), F.struct(F.lit(c).alias("class"), F.lit(p).alias("pattern"))) for p in ps]) for c, ps in lexicon.items()]
    return F.filter(F.array(*firsts), lambda x: x.isNotNull())


def roles(text: Column, lexicon: dict[str, list[str]] = L.ROLES) -> Column:
    """Roles in a text, sorted; SELF and OTHER where there is none."""
    found = F.array_sort(matched_classes(text, lexicon))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("OTHER"), F.lit("SELF")))


def relations(text: Column, lexicon: dict[str, list[str]] = L.RELATIONS) -> Column:
    return ranked_classes(text, lexicon, "CARE")


def consent(text: Column) -> Column:
    return first_class(text, L.CONSENT, "IMPLICIT_YES")


def bonds(roles_: Column, relations_: Column, consent_: Column, most: int = 3, reflexive: tuple[str, ...] = ("AUTONOMY", "CARE")) -> Column:
    """array<struct<agent, patient, relation, consent>>: the first relations with all pairs of roles; a role with itself in reflexive ones only."""

    def of(relation: Column) -> Column:
        pairs = F.flatten(F.transform(roles_, lambda a: F.transform(roles_, lambda p: F.struct(a.alias("agent"), p.alias("patient"), relation.alias("relation"), consent_.alias("consent")))))
        return F.filter(pairs, lambda b: (b["agent"] != b["patient"]) | relation.isin(*reflexive))

    return F.flatten(F.transform(F.slice(relations_, 1, most), of))


def signature(bonds_: Column) -> Column:
    """Canonical form: roles renamed R0, R1, ... as they first appear among bonds sorted by relation, agent and patient; "empty" without bonds."""
    ordered = F.array_sort(F.transform(bonds_, lambda b: F.struct(b["relation"].alias("relation"), b["agent"].alias("agent"), b["patient"].alias("patient"), b["consent"].alias("consent"))))

    def renamed(of: Column, names: Column) -> Column:
        role = lambda name: F.concat(F.lit("R"), (F.array_position(names, name) - 1).cast("string"))
        parts = F.transform(of, lambda b: F.struct(role(b["agent"]).alias("a"), role(b["patient"]).alias("p"), b["relation"].alias("r"), b["consent"].alias("c")))
        return F.array_join(F.transform(F.array_sort(parts), lambda x: F.concat(x["a"], F.lit("-"), x["p"], F.lit(":"), x["r"], F.lit("/"), x["c"])), "|")

    first_seen = lambda of: F.array_distinct(F.flatten(F.transform(of, lambda b: F.array(b["agent"], b["patient"]))))
    text = let(ordered, lambda of: let(first_seen(of), lambda names: renamed(of, names)))
    return F.when(F.size(bonds_) > 0, text).otherwise("empty")


def consensus(text: Column, dispute: list[str] = L.DISPUTE, universal: list[str] = L.UNIVERSAL) -> Column:
    """struct<tier, has_dispute>."""
    d, u = any_match(text, dispute), any_match(text, universal)
    return F.struct(F.when(d & ~u, "contested").when(u, "universal").otherwise("high").alias("tier"), (d & ~u).alias("has_dispute"))


def negated(text: Column, cues: list[str] = L.NEGATIONS, tokens: bool = False) -> Column:
    """Whether a cue is in the text: as a substring, or (tokens) as a word."""
    if tokens:
        return F.arrays_overlap(F.split(text, r"\s+"), F.array(*map(F.lit, cues)))
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(text, F.lit(cue))
    return out


def modal(text: Column, classes: dict[str, list[str]] = L.MODALS) -> Column:
    """struct<class, word>: the first modal word by order of declaration, as a substring; class "unknown" without one."""
    found = [F.when(F.contains(text, F.lit(w)), F.struct(F.lit(c).alias("class"), F.lit(w).alias("word"))) for c, ws in classes.items() for w in ws]
    return F.coalesce(*found, F.struct(F.lit("unknown").alias("class"), F.lit(None).cast("string").alias("word")))


def modal_state(class_: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in L.MODAL_STATE.items() for x in kv])[class_]


def modal_context(class_: Column) -> Column:
    return F.when(class_.isin("obligation", "prohibition"), "prescriptive").when(class_ == "permission", "descriptive").otherwise("unknown")


def bond(text: Column, lexicon: dict[str, list[str]], modals: dict[str, list[str]] = L.MODALS, cues: list[str] = L.NEGATIONS) -> Column:
    """struct<bond_type, state, negated, modal, confidence, context> of the first class that matches."""
    type_, m, no = first_class(text, lexicon), modal(text, modals), negated(text, cues)
    confidence = F.when(type_.isNotNull(), 0.9).otherwise(0.5) * F.when(no, 0.8).otherwise(1.0)
    return F.struct(
        type_.alias("bond_type"), modal_state(m["class"]).alias("state"), no.alias("negated"), m["word"].alias("modal"), confidence.alias("confidence"), modal_context(m["class"]).alias("context")
    )


def window_context(text: Column, at: Column, markers: dict[str, list[str]], window: int = 30) -> Column:
    """struct<context, marker> of the characters around a place (from 0): prohibition, obligation or permission, then negation."""
    begin = F.greatest(F.lit(0), at - window)
    around = F.substring(text, begin + 1, F.least(F.char_length(text), at + window) - begin)

    def kind(context: str, marker: str | None) -> Column:
        return F.struct(F.lit(context).alias("context"), F.lit(marker).cast("string").alias("marker"))

    found = [F.when(any_match(around, markers[k]), kind("prescriptive", k)) for k in ("prohibition", "obligation", "permission") if markers.get(k)]
    if markers.get("negation"):
        found.append(F.when(any_match(around, markers["negation"]), kind("descriptive", "negated")))
    return F.coalesce(*found, kind("descriptive", None)) if markers else kind("unknown", None)


def masked(text: Column, lexicon: dict[str, list[str]], mask: str = "[MASK]") -> Column:
    for ps in lexicon.values():
        for p in ps:
            text = F.regexp_replace(text, pattern(p), mask)
    return text


def with_fallback(levels: list[tuple[str, Column]]) -> Column:
    """struct<bond_type, method>: of the first level that has a bond; methods of the levels that had none are named in front."""
    out = F.struct(F.lit(None).cast("string").alias("bond_type"), F.lit("+".join(n for n, _ in levels)).alias("method"))
    for i in range(len(levels) - 1, -1, -1):
        method = levels[i][0] if i == 0 else f"{levels[0][0]}+{levels[i][0]}_fallback"
        out = F.when(levels[i][1].isNotNull(), F.struct(levels[i][1].alias("bond_type"), F.lit(method).alias("method"))).otherwise(out)
    return out


def suffix_roles(text: Column, agent: str, patient: str) -> Column:
    """struct<agent, patient>: the first word with each ending."""
    words = F.split(text, " ")
    return F.struct(F.get(F.filter(words, lambda w: w.endswith(agent)), F.lit(0)).alias("agent"), F.get(F.filter(words, lambda w: w.endswith(patient)), F.lit(0)).alias("patient"))


def gates(text: Column, table: list[tuple] = L.GATES) -> Column:
    """array<struct<kind, trigger, confidence, from, to, element>> of all gates whose trigger the text holds."""

    def gate(kind: str, trigger: str, confidence: float) -> Column:
        ends = {"binding": ("L", "O", "r2"), "release": ("O", "L", "r2")}.get(kind, (None, None, None))
        names = ("from", "to", "element")
        return F.struct(F.lit(kind).alias("kind"), F.lit(trigger).alias("trigger"), F.lit(confidence).alias("confidence"), *[F.lit(x).cast("string").alias(n) for n, x in zip(names, ends, strict=True)])

    return F.filter(F.array(*[F.when(text.rlike(pattern(p)), gate(k, t, c)) for k, p, t, c, _ in table]), lambda x: x.isNotNull())


def gate_state(gates_: Column, weight: float = L.ENGLISH_WEIGHT) -> Column:
    """struct<state, confidence>: the state with the higher score (O before L), its score capped at 1; nulls without a score."""

    def score(kind: str) -> Column:
        return F.aggregate(F.filter(gates_, lambda g: g["kind"] == kind), F.lit(0.0), lambda s, g: s + g["confidence"] * weight)

    o, l = score("binding"), score("release")
    best = F.greatest(o, l)
    return F.struct(F.when(best > 0, F.when(o >= l, "O").otherwise("L")).alias("state"), F.when(best > 0, F.least(best, F.lit(1.0))).alias("confidence"))


def role_capture(text: Column) -> Column:
    """struct<agent, patient>: who should, must or ought at the start of a text (I: speaker, you: addressee, or a name in lower case); whom is helped, protected, harmed or hurt, unless that is an article or a possessive."""
    said = r"\s+(should|must|ought)"
    name = F.nullif(F.lower(F.regexp_extract(text, rf"^([A-Z][a-z]+){said}", 1)), F.lit(""))
    agent = F.when(text.rlike(rf"(?i)^I{said}"), "speaker").when(text.rlike(rf"(?i)^You{said}"), "addressee").otherwise(name)
    whom = F.lower(F.regexp_extract(text, r"(?iU)(help|protect|harm|hurt)\s+(\w+)", 2))
    return F.struct(agent.alias("agent"), F.when((whom != "") & ~whom.isin("the", "a", "an", "my", "your"), whom).alias("patient"))


def _neighbours(chars: Column, skip: str, stop: str, nominals: str, forward: bool) -> Column:
    """Characters next to a predicate, nearest first, joined in the order of the text: at most two, none of `skip`; a nominal is the last, a `stop` ends before itself."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        ends = F.contains(F.lit(stop), c) if stop else F.lit(False)
        take = ~s["done"] & ~ends & ~F.contains(F.lit(skip), c)
        text = F.when(take, F.concat(s["text"], c) if forward else F.concat(c, s["text"])).otherwise(s["text"])
        done = s["done"] | ends | (take & (F.contains(F.lit(nominals), c) | (F.char_length(text) >= 2)))
        return F.struct(text.alias("text"), done.alias("done"))

    return F.nullif(F.aggregate(chars, start, step, lambda s: s["text"]), F.lit(""))


def positional(text: Column, c: dict = L.CHINESE) -> Column:
    """struct<bond_type, state, modal, negated, passive, causative, agent, patient, confidence> by the positions of single characters.

    The first predicate of the text has its agent within three characters before and its patient within three after; in a passive text it is the other
    way round. Modals that forbid have no state here.
    """
    chars = F.split(text, "")
    at = F.regexp_instr(text, F.lit(f"[{''.join(c['predicates'])}]"))
    predicate = F.create_map(*[F.lit(x) for kv in c["predicates"].items() for x in kv])
    modal_ = F.coalesce(*[F.when(F.contains(text, F.lit(m)), F.struct(F.lit(m).alias("word"), F.lit(s).cast("string").alias("state"))) for m, s in c["modals"].items()])
    passive, causative = text.rlike(f"[{c['passive']}]"), text.rlike(f"[{c['causative']}]")
    single = "".join(m for m in c["modals"] if len(m) == 1)
    left = F.reverse(F.slice(chars, F.greatest(F.lit(1), at - 3), F.least(at - 1, F.lit(3))))
    before = F.when(at > 1, _neighbours(left, c["particles"] + c["negation"] + single, "", c["nominals"], False))
    after = F.when(at > 0, _neighbours(F.slice(chars, F.greatest(at + 1, F.lit(1)), F.lit(3)), c["particles"], c["final"], c["nominals"], True))
    type_ = F.when(at > 0, predicate[F.substring(text, at, F.lit(1))])
    confidence = 0.5 + F.when(type_.isNotNull(), 0.2).otherwise(0.0) + F.when(before.isNotNull() | after.isNotNull(), 0.1).otherwise(0.0) + F.when(modal_.isNotNull(), 0.1).otherwise(0.0)
    return F.struct(
        type_.alias("bond_type"),
        modal_["state"].alias("state"),
        modal_["word"].alias("modal"),
        text.rlike(f"[{c['negation']}]").alias("negated"),
        passive.alias("passive"),
        causative.alias("causative"),
        F.when(passive, after).otherwise(before).alias("agent"),
        F.when(passive, before).otherwise(after).alias("patient"),
        F.round(confidence, 6).alias("confidence"),
    )


def morphological(text: Column, modals: dict[str, str], cues: list[str], marks: str, tokens: bool) -> Column:
    """struct<modal, state, context, negated, confidence> by substrings, in NFKC and without vowel marks: the first declared modal; a cue as a substring or (tokens) a whole word. No class is set.

    Without a modal the state is OBLIGATION and the context unknown.
    """
    plain = F.regexp_replace(T.unicode_normalise(text, "NFKC"), marks, "")

    def found(x: Column) -> Column:
        word = F.coalesce(*[F.when(F.contains(x, F.lit(m)), F.lit(m)) for m in modals])
        state = F.coalesce(*[F.when(word == m, F.lit(s)) for m, s in modals.items()], F.lit("OBLIGATION"))
        return F.struct(
            word.alias("modal"), state.alias("state"), F.when(word.isNotNull(), "prescriptive").otherwise("unknown").alias("context"),
            negated(x, cues, tokens).alias("negated"), F.when(word.isNotNull(), 0.7).otherwise(0.5).alias("confidence"),
        )

    return let(plain, found)
