"""Validation and classification of text fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of printed labels and headings.
STOP = ["REPUBLICA", "FEDERATIVA", "BRASIL", "MINISTERIO", "CIDADES", "DEPARTAMENTO", "NACIONAL", "TRANSITO", "CARTEIRA", "HABILITACAO", "NOME", "DOC", "IDENTIDADE", "ORG", "EMISSOR", "CPF", "DATA", "NASCIMENTO", "FILIACAO", "PERMISSAO", "CAT", "HAB", "VALIDADE", "REGISTRO", "VALIDA", "TERRITORIO", "ESTADO", "SECRETARIA", "SEGURANCA", "PUBLICA", "INSTITUTO", "IDENTIFICACAO", "PROIBIDO", "PLASTIFICAR", "ASSINATURA", "DIRETOR", "TITULAR", "POLEGAR", "DIREITO", "NATURALIDADE", "EXPEDICAO", "GERAL", "ORIGEM", "FAZENDA", "RECEITA", "FEDERAL", "CADASTRO", "PESSOAS", "FISICAS", "NUMERO", "INSCRICAO", "LV", "FL", "NAS", "CMC", "SEDE"]
#: Shapes of fields; digits are ASCII digits.
DATE = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"
FORMATTED_ID = r"^[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}$"
LONG_NUMBER = r"^[0-9]{7,}$"


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and each one's letter without."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Upper case without marks on Latin letters. strip_accents_nfkd has the compatibility forms too."""
    return F.upper(F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), *_accents()))


@F.pandas_udf(T.StringType())
def strip_accents_nfkd(texts: pd.Series) -> pd.Series:
    """Upper case of the NFKD form without combining marks; for text beyond Latin letters."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).upper())


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def once(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def check_digit(digits: Column, count: int) -> Column:
    """Check digit over the first `count` digits with weights from count + 1 down to 2; null if one is missing."""
    codes = [F.ascii(F.substr(digits, F.lit(i), F.lit(1))) - 48 for i in range(1, count + 1)]
    total = sum((c * (count + 2 - i) for i, c in enumerate(codes, 1)), F.lit(0))
    return F.when(F.length(digits) >= count, total * 10 % 11 % 10)


def _tail(nine: Column) -> Column:
    """The two check digits behind nine digits."""
    with_first = once(check_digit(nine, 9).cast("string"), lambda c: F.concat(nine, c))
    return once(with_first, lambda ten: F.concat(F.substr(ten, F.lit(10), F.lit(1)), check_digit(ten, 10).cast("string")))


def valid_cpf(text: Column) -> Column:
    """Whether the digits of a text are eleven, not all equal, and end in their two check digits. Null for null."""

    def check(d: Column) -> Column:
        right = F.substr(d, F.lit(10), F.lit(2)) == _tail(F.substr(d, F.lit(1), F.lit(9)))
        return (F.length(d) == 11) & ~d.rlike(r"^([0-9])\1{10}$") & F.coalesce(right, F.lit(False))

    return F.when(text.isNotNull(), once(digits_only(text), check))


def with_check_digits(nine: Column) -> Column:
    """Nine digits with their two check digits."""
    return once(nine, lambda n: F.concat(n, _tail(n)))


def format_id(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^([0-9]{3})([0-9]{3})([0-9]{3})([0-9]{2})$", "$1.$2.$3-$4")


def is_label(text: Column, stop: list[str] | None = None) -> Column:
    """Whether a word of the text, without accents, in upper case and cut at stops and slashes, is a label's."""
    words = F.split(F.regexp_replace(strip_accents(text), "[./]", " "), r"\s+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in (STOP if stop is None else stop)]))


def name_like(text: Column) -> Column:
    """At least two words with a letter, each of two characters or more, and no digit anywhere."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    return (F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) >= 2) & ~text.rlike(r"\p{Nd}")


def shape(text: Column) -> Column:
    """data, cpf, registro or nome by the form of the text, in this order; else null."""
    return F.when(text.rlike(DATE), "data").when(text.rlike(FORMATTED_ID), "cpf").when(text.rlike(LONG_NUMBER), "registro").when(name_like(text), "nome")


def char_coverage(text: Column, charset: Column) -> Column:
    """Share of a text's characters other than space that an array of characters has, in any case; 0 for none."""
    chars = F.filter(F.split(text, ""), lambda c: (c != "") & ~c.rlike(r"\s"))
    present = F.filter(chars, lambda c: F.array_contains(charset, c) | F.array_contains(charset, F.upper(c)) | F.array_contains(charset, F.lower(c)))
    return F.when(F.size(chars) > 0, F.size(present) / F.size(chars)).otherwise(F.lit(0.0))


def stem_prefix(path: Column) -> Column:
    """File name without folder and last extension, up to its first two underscores."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.split(stem, "__", 2)[0]


def document_of(name: Column) -> Column:
    """Document of an input image's name."""
    return F.replace(name, F.lit("_in.jpg"), F.lit(""))
