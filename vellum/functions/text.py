"""Scalar text functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes (for Java regular expressions).
HAN = "\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff"
GENERAL_PUNCTUATION = "“”‘’—…·～–―′″‰℃℉"
CJK = HAN + GENERAL_PUNCTUATION + "\\u3000-\\u303f\\uff00-\\uffef\\u3040-\\u30ff"
LATIN = "a-zA-Z0-9\\u00c0-\\u024f"
LATIN_WORD = LATIN + "_\\-"
BOX_DRAWING = "\\u2500-\\u25ff\\u2190-\\u21ff"
TWO_COLUMNS = HAN + "\\u3000-\\u30ff\\uff01-\\uff60“”‘’—…￥"

#: Marks that must not begin a line.
LINE_START_FORBIDDEN = "，。！？、；：．》〉」』）】〕〗］｝｠”’〞〟»›·…—～–―％%‰°′″℃.,!?;:)]}>'"
#: Marks that must not end a line.
LINE_END_FORBIDDEN = "《〈「『（【〔〖［｛｟“‘〝«‹([{<#$￥¥§"
#: Full-width marks whose right half is blank.
RIGHT_BLANK = "，。！？、；：．）》〉」』】〕〗］｝”’〞〟"

#: White space of the Unicode kind, as trimmed from the text of blocks.
UNICODE_SPACE = "[\\t-\\r\\u001c-\\u001f\\p{Z}]"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trim_control(text: Column) -> Column:
    """Without leading and trailing characters up to the blank, and ideographic spaces."""
    return F.regexp_replace(text, "^[\\u0000-\\u0020\\u3000]+|[\\u0000-\\u0020\\u3000]+$", "")


def trim_unicode(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, f"^{UNICODE_SPACE}+|{UNICODE_SPACE}+$", "")


def count_of(text: Column, char_class: str) -> Column:
    """How many characters of a class a text holds."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]", ""))


def em_width(text: Column) -> Column:
    """Width in em without font metrics: CJK one em, everything else half."""
    return (F.length(text) + count_of(text, CJK)) / 2


def grid_columns(text: Column) -> Column:
    """Width in half-em grid columns."""
    return F.length(text) + count_of(text, TWO_COLUMNS)


def optical_hang(text: Column) -> Column:
    """Part of the last character, in its own width, that may hang beyond the right margin."""
    last = F.right(text, F.lit(1))
    return (
        F.when(last == "", F.lit(0.0))
        .when(F.contains(F.lit(RIGHT_BLANK), last), F.lit(0.75))
        .when(F.contains(F.lit(LINE_START_FORBIDDEN), last), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


#: Characters with a raised or lowered form, and those forms.
RAISED = ("0123456789+-=()niabcdefghjklmoprstuvwxyzTABDEGHIJKLMNOPRUVW", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱᵃᵇᶜᵈᵉᶠᵍʰʲᵏˡᵐᵒᵖʳˢᵗᵘᵛʷˣʸᶻᵀᴬᴮᴰᴱᴳᴴᴵᴶᴷᴸᴹᴺᴼᴾᴿᵁⱽᵂ")
LOWERED = ("0123456789+-=()aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ")


def _shifted(text: Column, forms: tuple[str, str], mark: str) -> Column:
    plain = "".join("\\" + c if c in "-()+=" else c for c in forms[0])
    whole = text.rlike(f"^[{plain} ]*$")
    one = F.length(text) == 1
    bracketed = F.when(one, F.concat(F.lit(mark), text)).otherwise(F.concat(F.lit(mark + "("), text, F.lit(")")))
    return F.when(whole, F.translate(text, *forms)).otherwise(bracketed)


def superscript(text: Column) -> Column:
    """Raised form if every character has one, else ``^x`` or ``^(text)``."""
    return _shifted(text, RAISED, "^")


def subscript(text: Column) -> Column:
    """Lowered form if every character has one, else ``_x`` or ``_(text)``."""
    return _shifted(text, LOWERED, "_")


def decode_entities(text: Column) -> Column:
    """Six named references in fixed order, then hexadecimal, then decimal ones.

    Texts without an ampersand, most of them, are passed on as they are.
    """
    whole = text
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    decoded = F.when(F.contains(text, F.lit("&#")), _numeric(text)).otherwise(text)
    return F.when(F.contains(whole, F.lit("&")), decoded).otherwise(whole)


def _numeric(text: Column) -> Column:
    """Numeric references, replaced one after another by a fold over their distinct occurrences."""
    for pattern, base in (("&#x([0-9a-fA-F]+);", 16), ("&#([0-9]+);", 10)):
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

        def replaced(acc: Column, ref: Column, base: int) -> Column:
            code = F.conv(ref, base, 16)
            char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
            lead = "&#x" if base == 16 else "&#"
            fits = (F.length(code) <= 6) & (F.conv(ref, base, 10).cast("long") < 0x110000)
            return F.when(fits, F.replace(acc, F.concat(F.lit(lead), ref, F.lit(";")), char)).otherwise(acc)

        text = F.aggregate(found, text, (lambda b: lambda acc, ref: replaced(acc, ref, b))(base))
    return text


def xml_escape(text: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(ref))
    return text


def heading_scale(level: Column, base: float = 1.4) -> Column:
    """Size of a heading relative to the text, shrinking with its level."""
    extra = max(base - 1.0, 0.2)
    steps = F.array(*[F.lit(1.0 + extra * f) for f in (1.0, 0.72, 0.48, 0.28, 0.14, 0.06)])
    return F.element_at(steps, F.least(F.greatest(level, F.lit(1)), F.lit(6)))
