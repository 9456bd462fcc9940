"""Column functions: normalisation, masking and small parsers of docket text. All are built-in Spark expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]

# Role literals of the portal and the roles they stand for.
ROLES = {
    "REQTE.(S)": "requerente",
    "REQDO.(A/S)": "requerido",
    "ADV.(A/S)": "advogado",
    "AUT. POL.": "autoridade_policial",
    "INTDO.(A/S)": "interessado",
    "PROC.(A/S)(ES)": "procurador",
    "AGTE.(S)": "agravante",
    "AGDO.(A/S)": "agravado",
    "PACTE.(S)": "paciente",
    "IMPTE.(S)": "impetrante",
    "COATOR(A/S)(ES)": "coator",
    "AM. CURIAE.": "amicus_curiae",
    "RECTE.(S)": "recorrente",
    "RECDO.(A/S)": "recorrido",
    "EMBTE.(S)": "embargante",
    "EMBDO.(A/S)": "embargado",
    "AUTOR(A/S)(ES)": "autor",
    "RÉU(É)(S)": "reu",
    "DENUNCIADO(A/S)": "denunciado",
    "INVEST.(A/S)": "investigado",
    "RECLTE.(S)": "reclamante",
    "RECLDO.(A/S)": "reclamado",
    "BENEF.(A/S)": "beneficiario",
}
# Names that stand for no party.
PLACEHOLDERS = ("SEM REPRESENTAÇÃO NOS AUTOS", "SOB SIGILO")
# A lawyer's registration, as in 317282/SP, 30814/A/MT or 5922-A/AP; suffixes of companies.
REGISTRATION = r"\d+\s?-?\s?[A-Z]?(?:/[A-Z])?/[A-Z]{2}"
COMPANY = r"(?iU)\b(LTDA\.?|S\.?A\.?|S/A|EIRELI|EPP|ME|SOCIEDADE|PARTICIPACOES|PARTICIPAÇÕES|EMPREENDIMENTOS|CONSULTORIA|HOLDING)\b"
# Abbreviations that look like a vehicle plate's letters but aren't.
NOT_PLATES = (
    "INQ PET RCL ADI ADC ADO ADP ARE RHC RMS STA PSV EXT PPE SEC AOE RVC EMB AGR EDV IPL IPJ RIF NUP SEI PJE ANO LEI ART RES DPF"
).split()


# ------------------------------------------------------------ white space, dates


def clean_ws(c: Column) -> Column:
    """Runs of any white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def date_br(c: Column) -> Column:
    """dd/MM/yyyy; anything else is an error."""
    return F.to_date(c, "dd/MM/yyyy")


def datetime_br(c: Column) -> Column:
    return F.to_timestamp(c, "dd/MM/yyyy HH:mm:ss")


def try_date_br(c: Column) -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is none."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


# ------------------------------------------------------------ names


def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that decompose to one other without its marks, and those that decompose to several."""
    one, several = {}, []
    for i in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        to = "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))
        if to != chr(i):
            if len(to) == 1:
                one[chr(i)] = to
            else:
                several.append((chr(i), to))
    return "".join(one), "".join(one.values()), several


_FROM, _TO, _SEVERAL = _folding()


def without_marks(c: Column) -> Column:
    """Compatibility letters in their plain form, combining marks gone.

    ASCII is left as it is; most other texts only have letters that one other stands for.
    """
    single = F.translate(c, _FROM, _TO)
    every = F.regexp_replace(reduce(lambda a, x: F.replace(a, F.lit(x[0]), F.lit(x[1])), _SEVERAL, single), r"\p{Mn}", "")
    rare = f"[\\p{{Mn}}{''.join(x for x, _ in _SEVERAL)}]"
    return F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(~c.rlike(rare), single).otherwise(every)


def normalize_name(c: Column) -> Column:
    """Upper case without accents, white space collapsed."""
    return F.upper(clean_ws(without_marks(c)))


def normalize_key(c: Column) -> Column:
    """normalize_name without punctuation, hyphen and slash as spaces, `S A` as `SA`."""
    bare = F.regexp_replace(F.upper(without_marks(c)), r"[.,;:'\"()\[\]{}«»“”‘’—–]", "")
    return F.regexp_replace(clean_ws(F.regexp_replace(bare, r"[-/]", " ")), r"\bS\s?A\b", "SA")


def canonical(aliases: Mapping[str, str]) -> dict[str, str]:
    """Where each alias ends; a chain that comes back to a key it has passed stops there."""
    out = {}
    for key in aliases:
        at, seen = key, set()
        while at in aliases and at not in seen:
            seen.add(at)
            at = aliases[at]
        out[key] = at
    return out


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """The value that a small table gives for c, else null."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def canonical_key(c: Column, aliases: Mapping[str, str]) -> Column:
    return F.coalesce(mapped(c, canonical(aliases)), c)


def minister_name(c: Column) -> Column:
    bare = F.regexp_replace(c, r"(?i)^\s*(?:MIN\.?|MINISTR[OA])\s+", "")
    return F.trim(F.regexp_replace(bare, r"(?i)\s*\((?:relatora?|revisora?|presidente)\)\s*$", ""))


def minister_key(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    return canonical_key(F.concat(F.lit("ministro:"), normalize_key(minister_name(c))), aliases or {})


def name_key(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    return canonical_key(F.concat(F.lit("nome:"), normalize_key(c)), aliases or {})


def entity_key(role: Column, name: Column, registrations: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """A lawyer with registrations is known by the first; all others by name."""
    first = F.get(registrations, F.lit(0))
    return F.when((role == "advogado") & first.isNotNull(), F.concat(F.lit("oab:"), first)).otherwise(name_key(name, aliases))


def entity_type(role: Column) -> Column:
    return F.when(role == "advogado", "advogado").otherwise("parte")


def likely_company(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(COMPANY)), "pessoa_juridica")


def split_registration(c: Column) -> Column:
    """struct(nome, oab): a name and the registrations in brackets behind it."""
    pattern = rf"^(.*?)\s*\(((?:{REGISTRATION}(?:,\s*)?)+)\)\s*$"
    codes = F.transform(F.split(F.regexp_extract(c, pattern, 2), ","), clean_ws)
    found = F.regexp_like(c, F.lit(pattern))
    none = F.array().cast("array<string>")
    return F.struct(F.when(found, clean_ws(F.regexp_extract(c, pattern, 1))).otherwise(c).alias("nome"), F.when(found, F.filter(codes, lambda x: x != "")).otherwise(none).alias("oab"))


def normalize_role(c: Column) -> Column:
    return F.coalesce(mapped(c, ROLES), F.concat(F.lit("desconhecido:"), c))


def is_placeholder(c: Column) -> Column:
    return c.isin(*PLACEHOLDERS)


def role_status(role: Column, statuses: Mapping[str, str]) -> Column:
    """The status shown for a role, the role itself where the table has none."""
    return F.coalesce(mapped(role, statuses), role)


def classify_first_match(c: Column, rules: Rules, default: str | None = None) -> Column:
    """The label of the first rule one of whose patterns matches."""
    tests = [F.when(F.regexp_like(c, F.lit("|".join(f"(?:{p})" for p in patterns))), F.lit(label)) for label, patterns in rules]
    return F.coalesce(*tests, F.lit(default).cast("string"))


def event_category(kind: Column, decision: Column, agenda: Column, rules: Rules) -> Column:
    """Flags come before the rules on the folded type."""
    return F.when(decision, "decisao").when(agenda, "julgamento").otherwise(classify_first_match(normalize_name(kind), rules, "outro"))


def document_function(title: Column, decision: Column, rules: Rules) -> Column:
    """The rules on the folded title; an order that the portal marks as a decision is one."""
    found = classify_first_match(normalize_name(F.coalesce(title, F.lit(""))), rules, "outro")
    return F.when((found == "despacho") & decision, "decisao").otherwise(found)


# ------------------------------------------------------------ links, headers, details


def document_link(href: Column, base: str) -> Column:
    """struct(endpoint, id_portal, formato, url) of a link to a document: endpoint.ext?id=N&ext=.FMT."""
    url = F.when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(href, "^/+", "")))
    query = F.lower(F.coalesce(extract(href, r"(?i)[?&]ext=\.?([A-Za-z]+)"), F.lit("pdf")))
    return F.struct(extract(url, r"/([A-Za-z0-9_]+)\.[A-Za-z]+\?").alias("endpoint"), extract(href, r"(?i)[?&](?:id|docID)=(\d+)").alias("id_portal"), query.alias("formato"), url.alias("url"))


def header_fields(c: Column) -> Column:
    """struct of what a case's header says: number, rapporteur, rapporteur of the last incident with its label, literal flags."""
    text = F.split_part(c, F.lit(" Todos "), F.lit(1))
    has = lambda x: F.contains(text, F.lit(x))
    return F.struct(
        extract(text, r"Número Único:\s*([\d.\-]+)").alias("numero_unico"),
        extract(text, r"Relator\(a\):\s*(.+?)\s*(?:Relator\(a\) do último incidente:|$)").alias("relator"),
        extract(text, r"Relator\(a\) do último incidente:\s*(.+?)\s*\(([^)]+)\)").alias("relator_ultimo_incidente"),
        extract(text, r"Relator\(a\) do último incidente:\s*(.+?)\s*\(([^)]+)\)", 2).alias("ultimo_incidente"),
        has("Réu Preso").alias("reu_preso"),
        F.when(has("Criminal"), "Criminal").when(has("Cível"), "Cível").alias("natureza"),
        F.when(has("Processo Eletrônico"), "Processo Eletrônico").when(has("Processo Físico"), "Processo Físico").alias("tipo_tramitacao"),
    )


def publicity(scripts: Column) -> Column:
    return extract(scripts, r"if\s*\(\s*'(Público|Sigiloso)'\s*==")


def label_value_pairs(items: Column) -> Column:
    """map from label to value: in an ordered array of texts one that ends in a colon names the next that doesn't."""
    start = F.struct(F.lit(None).cast("string").alias("label"), F.create_map().cast("map<string,string>").alias("pairs"))

    def step(acc: Column, x: Column) -> Column:
        label, pairs = acc["label"], acc["pairs"]
        rest = F.map_filter(pairs, lambda k, v: k != label)
        put = F.struct(F.lit(None).cast("string").alias("label"), F.map_concat(rest, F.map_from_arrays(F.array(label), F.array(x))).alias("pairs"))
        named = F.struct(F.rtrim(F.substring(x, F.lit(1), F.length(x) - 1)).alias("label"), pairs.alias("pairs"))
        return F.when(x == "", acc).when(F.endswith(x, F.lit(":")), named).when(label.isNotNull(), put).otherwise(acc)

    return F.aggregate(F.transform(items, clean_ws), start, step, lambda acc: acc["pairs"])


def petition_details(c: Column) -> Column:
    """struct(data_peticionamento, recebido_em, recebido_por) of `Peticionado em d` and `Recebido em t por X`."""
    return F.struct(
        try_date_br(extract(c, r"(?i)Peticionado em\s+(\d{2}/\d{2}/\d{4})")).alias("data_peticionamento"),
        F.try_to_timestamp(extract(c, r"(?i)Recebido em\s+(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2})"), F.lit("dd/MM/yyyy HH:mm:ss")).alias("recebido_em"),
        extract(c, r"(?i)Recebido em\s+[\d/]+ [\d:]+\s+por\s+(.+?)\s*$").alias("recebido_por"),
    )


def movement_details(c: Column) -> Column:
    """struct(enviado_por, data_envio, guia, recebido_em) of a physical movement."""
    return F.struct(
        extract(c, r"(?i)Enviado por\s+(.+?)\s+em\s+\d{2}/\d{2}/\d{4}").alias("enviado_por"),
        try_date_br(extract(c, r"(?i)Enviado por\s+.+?\s+em\s+(\d{2}/\d{2}/\d{4})")).alias("data_envio"),
        extract(c, r"(?i)Guia\s*(?:n[º°o.]*\s*)?:?\s*([\d./-]+)").alias("guia"),
        try_date_br(extract(c, r"(?i)Recebido em\s+(\d{2}/\d{2}/\d{4})")).alias("recebido_em"),
    )


def resolve_case(final_url: Column, html: Column) -> Column:
    """struct(status, incidente): from the address that a search ended at, else from the different ids in the page."""
    own = extract(final_url, r"(?i)detalhe\.asp\?incidente=(\d+)")
    ids = F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"incidente=(\d+)"), F.lit(1)))
    status = F.when(own.isNotNull() | (F.size(ids) == 1), "resolvido").when(F.size(ids) > 1, "multiplo").otherwise("nao_encontrado")
    return F.struct(status.alias("status"), F.coalesce(own, F.when(F.size(ids) == 1, F.get(ids, F.lit(0)))).cast("long").alias("incidente"))


# ------------------------------------------------------------ money and masks


def cents(c: Column) -> Column:
    """R$ 1.234,56 as 123456; text without such an amount is an error."""
    found = F.regexp_extract(c, r"R?\$?\s*([\d.]+,\d{2})", 1)
    bad = F.raise_error(F.concat(F.lit("amount not recognised: "), c)).cast("bigint")
    return F.when(c.isNull(), F.lit(None).cast("bigint")).when(found == "", bad).otherwise(F.regexp_replace(found, "[.,]", "").cast("bigint"))


def try_cents(c: Column) -> Column:
    return F.expr("try_cast(null as bigint)") if c is None else F.regexp_replace(extract(c, r"R?\$?\s*([\d.]+,\d{2})"), "[.,]", "").cast("bigint")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _actor_forms(c: Column) -> list[tuple[Column, Column, str]]:
    """(test, key, kind) of each form that names an actor."""
    d = _digits(c)
    return [
        (F.startswith(c, F.lit("nome:")), F.concat(F.lit("nome:"), normalize_name(F.substring(c, 6, 10_000))), "desconhecido"),
        (c.rlike(r"^cpf:\d{6}$"), c, "pessoa_fisica"),
        (c.rlike(r"^cnpj:\d{14}$"), c, "pessoa_juridica"),
        (F.length(d) == 14, F.concat(F.lit("cnpj:"), d), "pessoa_juridica"),
        (F.length(d) == 11, F.concat(F.lit("cpf:"), F.substring(d, 4, 6)), "pessoa_fisica"),
    ]


def is_actor(c: Column) -> Column:
    """Whether actor_key takes the document; null stays null."""
    return reduce(lambda a, x: a | x[0], _actor_forms(c), F.lit(False))


def actor_key(c: Column) -> Column:
    """struct(chave, tipo) of an actor's document: companies whole, persons by the six middle digits, others by name."""
    bad = F.raise_error(F.concat(F.lit("document not recognised: "), c)).cast("struct<chave:string,tipo:string>")
    out = F.when(c.isNull(), F.lit(None).cast("struct<chave:string,tipo:string>"))
    for test, key, kind in _actor_forms(c):
        out = out.when(test, F.struct(key.alias("chave"), F.lit(kind).alias("tipo")))
    return out.otherwise(bad)


def mask_document(c: Column) -> Column:
    """A person's document shows its six middle digits, a company's is written out, a name has none."""
    d = _digits(c)
    person = lambda x: F.concat(F.lit("***."), F.substring(x, 1, 3), F.lit("."), F.substring(x, 4, 3), F.lit("-**"))
    company = F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")
    return F.when(F.startswith(c, F.lit("nome:")), F.lit(None).cast("string")).when(c.rlike(r"^cpf:.{6}$"), person(F.substring(c, 5, 6))).when(F.length(d) == 11, person(F.substring(d, 4, 6))).when(F.length(d) == 14, company).otherwise(c)


# A person's number alone or formatted, an identity card, a home address.
PERSON = r"(?<![\d./-])(\d{3})\.?(\d{3})\.?(\d{3})-?(\d{2})(?!\d)(?![./-]\d)"
IDENTITY = r"(?i)RG\s*n[ºo°]?\s*[\d.]+-?[A-Z]{2,5}/?[A-Z]{0,2}"
HOME = r"(?isU)domiciliad[oa]s?\s+nesta\s+Capital,.*?(?=,\s*o\s+im[óo]vel|$)"


def mask_text(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, HOME, "[endereço omitido]"), IDENTITY, "RG [omitido]")
    return F.regexp_replace(out, PERSON, r"***.$2.$3-**")


def mask_phone(c: Column) -> Column:
    """Runs of 10 to 15 digits keep the first four; every other digit is a dot."""
    return reduce(lambda a, n: F.regexp_replace(a, rf"\b(\d{{4}})\d{{{n}}}\b", "$1" + "•" * n), range(6, 12), c)


def mask_plate(c: Column) -> Column:
    return F.regexp_replace(c, rf"\b(?!(?:{'|'.join(NOT_PLATES)})[-\d ])[A-Z]{{3}}(?:-?\d[A-Z]\d{{2}}|[- ]?\d{{4}})\b", "[placa omitida]")


# ------------------------------------------------------------ quotes, sentences, terms


def quote_norm(c: Column) -> Column:
    return F.lower(F.replace(clean_ws(c), F.lit("ß"), F.lit("ss")))


def strip_all_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def sentence_split(c: Column) -> Column:
    """Footers dropped, broken lines joined, split behind . ! ? : ; before a capital, quote or bracket."""
    lines = F.filter(F.transform(F.split(c, r"\R"), F.trim), lambda x: (x != "") & ~x.rlike(r"^(?:Página \d+ de \d+|IPJ-A nº .+)$"))
    return F.filter(F.transform(F.split(F.array_join(lines, " "), r"(?<=[.!?:;])\s+(?=[A-ZÀ-Ú“\"(])"), F.trim), lambda x: x != "")


def judgement_terms(c: Column, terms: Sequence[str], legal: Sequence[str]) -> Column:
    """The loaded words outside quotation marks, legal names of crimes removed first."""
    outside = F.regexp_replace(c, r"[“\"][^“”\"]*[”\"]", " ")
    for x in legal:
        outside = F.regexp_replace(outside, f"(?iu){x}", " ")
    return F.regexp_extract_all(F.lower(outside), F.lit(rf"(?iuU)\b((?:{'|'.join(terms)}))\b"), F.lit(1))


def excerpt(text: Column, start: Column, end: Column, margin: int = 60) -> Column:
    """The literal around [start, end), counted from 0, white space collapsed."""
    a = F.greatest(start - margin, F.lit(0))
    b = F.least(end + margin, F.length(text))
    return clean_ws(F.substring(text, a + 1, b - a))
