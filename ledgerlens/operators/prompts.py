"""Per-row prompts, built as native string expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import as_text, is_blank, money_text
from ledgerlens.operators.rules import (ABBREVIATIONS, CHANNELS, ID_PATTERN, LEXICON, NOTE_PURPOSE, PLATFORMS,
                                        PURPOSE_WORDS)
from ledgerlens.schema import MONEY


def _known_groups() -> dict[str, list[str]]:
    """Category -> its subcategories, from the lexicon's fixed values."""
    groups: dict[str, list[str]] = {}
    for _kw, category, subcategory, _kind, _direction in LEXICON:
        own = groups.setdefault(category, [])
        if subcategory and subcategory not in own:
            own.append(subcategory)
    return groups


_GROUPS = _known_groups()
_SHORT_FORMS = ", ".join(f"{short} is {long}" for short, long in ABBREVIATIONS)

REMARK_SYSTEM_PROMPT = f"""Every message holds one payment remark from an Indian bank account \
({", ".join(CHANNELS)}), its parts divided by slashes. Say what the payment was for.

Work in this order and stop at the first that applies:
1. a part that names a purpose ({", ".join(PURPOSE_WORDS[:6])} and the like);
2. a person or a shop, with the payment verb if there is one;
3. a payment app ({", ".join(PLATFORMS)});
4. nothing but a reference number: say so.
Handles, account numbers and bank codes say nothing about the purpose. Expand short forms: {_SHORT_FORMS}. \
Give remarks that differ only in their numbers the same reading.

Output: a JSON object with two string members. "cleaned_remark" is the reading in a few plain words; \
"notes_doubts" says what stays uncertain, or is {NOTE_PURPOSE} when nothing does. No other text."""

CATEGORY_SYSTEM_PROMPT = f"""Every message holds one bank transaction: a description and the amounts that left \
and entered the account. File it under a spending category.

Categories in use, each with its subcategories in brackets: \
{"; ".join(name + (f" [{', '.join(own)}]" if own else "") for name, own in _GROUPS.items())}.
Another category may be made up if none fits: one to three words, the same words every time. \
A category listed without brackets has an empty subcategory.

Money that enters the account is a salary, a refund, family support or work credit; money moved between \
the holder's own accounts is a transfer. A known brand decides where no purpose is stated. A small payment \
to a named shop is most often for groceries. Where nothing decides, the category is Unclear.

Output: a JSON object with the string members "category", "subcategory" and "confidence" (High for a stated \
purpose, Medium for a brand, Low for a guess). No other text."""

REMARK_PROMPT_HEAD = "Explain this transaction remark in plain words:\n\nTransaction Remark: "
REMARK_PROMPT_TAIL = "\n\nAnswer as the JSON object described."
CATEGORY_PROMPT_HEAD = "Categorise this transaction:\n\nTransaction Remarks: "
CATEGORY_PROMPT_TAIL = "\n\nAnswer as the JSON object described."


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remark_prompt(remarks) -> Column:
    """Prompt for one remark; NULL when the remark is blank (no call)."""
    text = as_text(_c(remarks))
    return F.when(~is_blank(text), F.concat(F.lit(REMARK_PROMPT_HEAD), text,
                                            F.lit(REMARK_PROMPT_TAIL)))


# A place in a template where a row's own text goes: mark, number from 1, mark.
SLOT_OPEN, SLOT_CLOSE = "⟦", "⟧"
# An id part (:data:`ledgerlens.operators.rules.ID_PATTERN`) between slashes: spaces before it, the id, spaces after it. A line
# break may follow a number or code, as ``$`` has it.
_LAST_BREAK = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?"
_ID_PART = (rf"(?<![^/])( *)([0-9]{{6,}}{_LAST_BREAK}|ICI[0-9a-fA-F]+{_LAST_BREAK}|(?=[^/]*@)[^ /](?:[^/]*[^ /])?)( *)(?![^/])")


def with_remark_template(df, remarks: str = "remarks", template: str = "_template", slots: str = "_slots"):
    """Add the remark with its id parts (numbers, handles, bank codes) as numbered slots, and the slots' texts.

    Remarks that differ in such parts only have one template. A part is what slashes divide, without the spaces
    around it; the rest of the remark stays as it is. A remark that holds a slot mark itself is its own template, without slots."""
    text = as_text(_c(remarks))
    # Built-in regex functions, each over the whole remark; what stands between the ids is joined by the numbered slots.
    marked = F.regexp_replace(text, F.lit(_ID_PART), F.lit("$1" + SLOT_OPEN + SLOT_CLOSE + "$3"))
    numbered = F.transform(F.split(marked, SLOT_OPEN + SLOT_CLOSE, -1), lambda p, i: F.when(i > 0, F.concat(
        F.lit(SLOT_OPEN), i.cast("string"), F.lit(SLOT_CLOSE), p)).otherwise(p))
    plain = F.contains(text, F.lit(SLOT_OPEN)) | F.contains(text, F.lit(SLOT_CLOSE))
    own = F.regexp_extract_all(text, F.lit(_ID_PART), F.lit(2))
    return df.withColumns({template: F.when(plain, _c(remarks).cast("string")).when(_c(remarks).isNotNull(), F.array_join(numbered, "")),
                           slots: F.when(plain, F.array().cast("array<string>")).otherwise(own)})


def filled(reply: Column, slots: Column) -> Column:
    """A reply with the slots' texts put back, as JSON writes them inside a string."""
    def put(text, slot):
        written = F.to_json(F.struct(slot["v"].alias("v")))
        return F.replace(text, F.concat(F.lit(SLOT_OPEN), slot["i"].cast("string"), F.lit(SLOT_CLOSE)),
                         F.substring(written, F.lit(7), F.length(written) - 8))
    put_back = F.aggregate(F.transform(slots, lambda v, i: F.struct((i + 1).alias("i"), v.alias("v"))), reply, put)
    return F.when(F.contains(reply, F.lit(SLOT_OPEN)), put_back).otherwise(reply)


def amount_or_zero(c) -> Column:
    """Missing amount -> 0 (so the prompt shows 0.00)."""
    return F.coalesce(_c(c).try_cast(MONEY), F.lit(0).cast(MONEY))


def category_prompt(description, withdrawal, deposit) -> Column:
    """Prompt for one description and its amounts; NULL when blank (no call)."""
    text = as_text(_c(description))
    body = F.concat(F.lit(CATEGORY_PROMPT_HEAD), text,
                    F.lit("\nWithdrawal Amount(INR): "), money_text(amount_or_zero(withdrawal)),
                    F.lit("\nDeposit Amount(INR): "), money_text(amount_or_zero(deposit)),
                    F.lit(CATEGORY_PROMPT_TAIL))
    return F.when(~is_blank(text), body)
