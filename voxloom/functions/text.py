"""Text functions on columns: trimming, repetition clean-up, spelling, role and question splits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.numbers import exact_round
from voxloom.params import DEFAULTS, FIRST_SPEAKER, SECOND_SPEAKER

# Unicode white space plus the four ASCII separators that string splitting also treats as blank.
SPACE = r"[\s\x1C-\x1F]"
# Up to so many phrases are searched for one by one.
FEW_PHRASES = 32


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def words_of(col: Column) -> Column:
    return F.array_remove(F.split(col, rf"(?U){SPACE}+"), "")


# Repeats in a lower-case text of single-blank words, or of parts joined by ", ".
# Possessive groups: no backtracking, no recursion on long runs.
PHRASE_REPEATS = r"(?<!\S)(\S++) (\S++)(?: \1 \2(?!\S)){2}"
WORD_REPEATS = r"(?<!\S)(\S++)(?: \1(?!\S)){2}"
PART_REPEATS = r"(?:^|, )([^,]++)(?:, \1(?=,|$)){2}"


def drop_long_runs(items: Column, lowered: Column) -> Column:
    """Keep one item of every run of three or more equal ones; pairs stay."""

    def keep(x: Column, i: Column) -> Column:
        at = lambda k: F.get(lowered, i + k)
        same_before = (i >= 1) & (at(0) == at(-1))
        third = ((i >= 2) & (at(-1) == at(-2))) | F.coalesce(at(0) == at(1), F.lit(False))
        return ~(same_before & third)

    return F.filter(items, keep)


def collapse_phrases(items: Column, lowered: Column) -> Column:
    """Keep one copy of a two-word phrase said three or more times in a row.

    Each word stands behind its lower-case form in one string; a back-reference
    over the lower-case forms finds the repeats, and the words that remain are
    taken out again (no word holds a line end). The work grows with the text's length.
    """
    paired = F.array_join(F.zip_with(lowered, items, lambda low, w: F.concat(low, F.lit("\n"), w)), " ")
    word = r"(\S+)\n(\S+)"
    repeat = rf"(?U)(?<!\S){word} {word}(?: \1\n\S+ \3\n\S+(?!\S)){{2,}}+"
    left = F.split(F.regexp_replace(paired, repeat, "$1\n$2 $3\n$4"), " ")
    return F.transform(left, lambda t: F.substring_index(t, "\n", -1))


# Day names, day suffixes and phonetic corrections.
DAYS = ("pazartesi", "salı", "çarşamba", "perşembe", "cuma", "cumartesi", "pazar")
DAY_SUFFIXES = ("günü", "gün", "sabahı", "akşamı")
CORRECTIONS = (
    (r"\bbeyni\b(?=\s+(bırak|bırakır|yap|buton|atar|ver))", "beğeni"),
    (r"\bbir\s+beyni\b", "bir beğeni"),
    (r"\bArkadaşıar\b", "Arkadaşlar"),
    (r"\barkadaşıar\b", "arkadaşlar"),
    (r"\btüpçeyi\b", "Türkçeyi"),
    (r"\btüpçe\b", "Türkçe"),
    (r"\bakıcık\b", "Akıcı"),
)


def normalise_turkish(col: Column) -> Column:
    """No blank before punctuation, day names split from their suffix, known mis-hearings corrected."""
    out = F.regexp_replace(col, rf"(?U){SPACE}+([?!,.:;])", "$1")
    # One pass: no day name can match inside another's place because of the word boundaries.
    out = F.regexp_replace(out, rf"(?iuU)\b({'|'.join(DAYS)})({'|'.join(DAY_SUFFIXES)})\b", "$1 $2")
    for pattern, right in CORRECTIONS:
        out = F.regexp_replace(out, f"(?iuU){pattern}", right)
    return out


# Role triggers and greetings of the call-centre domain.
AGENT_TRIGGERS = (
    "buyurun",
    "müşteri hizmetleri",
    "nasıl yardımcı olabilirim",
    "anladım hanımefendi",
    "anladım beyefendi",
    "anladım efendim",
    "şikayetinizi not aldım",
    "size geri dönüş yapacağız",
)
CUSTOMER_TRIGGERS = ("merhaba ben", "şikayetim var", "sorunlar yaşıyorum", "iade edilmesini talep ediyorum")
GREETINGS = ("müşteri hizmetleri", "hizmetleri birimi", "hoş geldiniz", "çağrı merkezi", "temsilciniz")


def triggers_for(domain_mode: str | None, custom: dict | None = None) -> list[str]:
    """Trigger phrases in search order; callers may add their own per role."""
    custom = custom or {}
    centre = domain_mode == "call_center"
    agent = [*(AGENT_TRIGGERS if centre else ()), *custom.get("agent_triggers", ())]
    customer = [*(CUSTOMER_TRIGGERS if centre else ()), *custom.get("customer_triggers", ())]
    return agent + customer


def has_any(text: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def other_speaker(speaker: Column) -> Column:
    return F.when(speaker == FIRST_SPEAKER, SECOND_SPEAKER).otherwise(FIRST_SPEAKER)


def trigger_place(lowered: Column, triggers: Sequence[str], min_offset: int = DEFAULTS.trigger_min_offset) -> Column:
    """1-based place of the first trigger (list order) whose first occurrence
    lies at ``min_offset`` characters or later; 0 if there is none.

    A few triggers are as many built-in searches; of more than ``FEW_PHRASES`` an automaton finds all in one pass over
    the text, with the same result.
    """
    if len(triggers) > FEW_PHRASES:
        return _phrase_finder(triggers, min_offset)(lowered)
    places = [F.instr(lowered, t) for t in triggers]
    return F.coalesce(*[F.when(p > min_offset, p) for p in places], F.lit(0)) if places else F.lit(0)


def _phrase_finder(triggers: Sequence[str], min_offset: int):
    rank: dict[str, int] = {}
    for n, t in enumerate(triggers):
        rank.setdefault(t, n)

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = ahocorasick.Automaton()
        for t, n in rank.items():
            if t:
                words.add_word(t, (n, len(t)))
        words.make_automaton()

        def of(text: str | None) -> int:
            if text is None:
                return 0
            first = {rank[""]: 1} if "" in rank else {}
            for end, (n, size) in words.iter(text):
                first.setdefault(n, end - size + 2)
            late = [n for n, at in first.items() if at > min_offset]
            return first[min(late)] if late else 0

        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="int32")

    return place


def question_pieces(whole: Column) -> Column:
    """Stripped text cut after each run of question marks; a run shrinks to one
    mark, except that a run with nothing before it stands for itself."""
    runs = F.regexp_extract_all(whole, F.lit(r"([^?]*)(\?+|$)"), F.lit(0))

    def mark(s: Column) -> Column:
        body = strip(F.regexp_replace(s, r"\?+$", ""))
        return F.when(body == "", strip(s)).otherwise(F.concat(body, F.when(s.endswith("?"), "?").otherwise("")))

    return F.filter(F.transform(runs, mark), lambda s: s != "")


def piece_ends(lengths: Column, start: Column, length: Column, total: Column) -> Column:
    """Start of the first piece, then each piece's rounded end; every end is the next one's start."""
    return F.aggregate(
        lengths,
        F.array(start),
        lambda acc, n: F.concat(acc, F.array(exact_round(F.element_at(acc, -1) + n / total * length))),
    )


def piece(speaker: Column, start: Column, end: Column, text: Column) -> Column:
    return F.struct(
        speaker.alias("speaker_id"), start.alias("start_time"), end.alias("end_time"), text.alias("text")
    )
