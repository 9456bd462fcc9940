"""Police prose that retells conversations: pages to ordered items, in Spark expressions alone."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.extract import OMITTED, SECTORS, let
from dossier.functions.text import clean_ws, mask_phone, mask_plate, mask_text, normalize_name

# Verbs of speech, openings of a sentence, how a subject goes on, what stands before a quotation that isn't speech,
# what begins a sentence behind a caption, and the shapes of names, captions, section titles and footers.
VERBS = (
    "diz|responde|escreve|pergunta|questiona|informa|encaminha|envia|orienta|pede|repassa|confirma|afirma|manda|complementa|finaliza|reencaminha|comenta|retoma|conversa|"
    "solicita|reclama|avisa|explica|esclarece|acrescenta|devolve|cobra|insiste|agradece|conclui|relata|sugere|propõe|alerta"
)
OPENINGS = (
    "Na sequência|Em seguida|Logo depois|Logo em seguida|Ainda|Depois|Minutos depois|Alguns minutos depois|Imediatamente|No mesmo dia|Nesse momento|Neste momento|"
    "Na mesma conversa|Mais tarde|Antes disso|Após|Em resposta|Pouco depois|Instantes depois|Então"
)
GOES_ON = "depois|e|em seguida|também|ainda|então|logo|por fim|adiante"
NOT_SPEECH = r"como|denominad\w{0,20}|intitulad\w{0,20}|usuário|contato|chamad\w{0,20}|segundo|salvo|emoji de|refere-se a|apelid\w{0,20}"
BEFORE_A_NAME = "a|para|ao|à|com|de|do|da"
NAME_LINKS = "de|da|do|dos|das|e"
NAME = r"[A-ZÀ-Ú][A-ZÀ-Ú.\-]++(?:\s++(?:[A-ZÀ-Ú][A-ZÀ-Ú.\-]++|DE|DA|DO|DOS|DAS|E))*+"
SENTENCE_START = (
    rf"Em \d|[Àà]s \d|{OPENINGS}|Como|Para |Registre|Observ|Nota-se|Verific|Constat|Também|Além|Ess[ea]s?\b|Est[ea]s?\b|Os? |As? |Segundo|Conforme|Cabe|Import|Ressalt|Destac|"
    rf"Já |Mais|N[oa]s? |Seus? |Suas? |Trata|Tal|Dess[ea]|Nest|{NAME}\s+(?:{VERBS})\b"
)
CAPTION = r"Figura \d+[^\S\n]+[–\-][^\S\n]+[^\n]+"
TITLE = r"\d{1,2}(?:\.\d{1,2}){0,3}\.?[^\S\n]+[A-ZÀ-Ú][^.\n]{3,140}$"
FOOTER = r"^(?:Página \d+ de \d+|IPJ-A nº .+)$"
BREAK = r"(?U)(?<=[.!?:;])\s+(?=[A-ZÀ-Ú“\"(])"
QUOTATION = r"[“\"]([^“”\"]+)[”\"]"

#: A caption or title goes on for two lines at most, unless it ends in a point or the line begins a sentence; a title's lines begin small.
UNENDED = r"(?<![.:;!?”\"])\n"
BLOCK = rf"(?mU)^(?:{CAPTION}(?:{UNENDED}(?!{CAPTION}|{TITLE}|{SENTENCE_START})[^\n]+){{0,2}}|{TITLE}(?:{UNENDED}(?!{SENTENCE_START})(?=\p{{Ll}})[^\n]+){{0,2}})"
#: A contact as saved on the device is named in quotation marks.
CONTACT = r"[“\"][A-ZÀ-Ú][^“”\"]{1,40}[”\"]"
SPEAKER = rf"(?:{NAME}|{CONTACT})"
#: Groups: day, hour, zone, sender, verb, receiver, message.
MESSAGE = (
    rf"(?sU)^(?:(?:{OPENINGS})[^“”\",]{{0,40}}?,\s*)?(?:[Ee]m (\d{{2}}/\d{{2}}/\d{{4}}),?\s*)?(?:[Àà]s (\d{{2}}:\d{{2}})(?::\d{{2}})?\s*(-\s?03:00|UTC-3|UTC)?,?\s*)?"
    rf"({SPEAKER})\s+({VERBS})\s+(?:(?:a|para|ao|à)\s+({SPEAKER})\s*,?\s*)?(?:(?:que|a mensagem|a seguinte mensagem|o seguinte|o texto)\s+|:\s*)?{QUOTATION}.*$"
)
#: A name found anywhere begins where its run of capitals does, so that a long run is read once, not once from each of its words.
RUN = r"(?<![A-ZÀ-Ú])(?<![A-ZÀ-Ú][A-ZÀ-Ú.\-]\s)"
NAMED = rf"((?:{RUN}{NAME}|{CONTACT}))(?:\s*\(terminal [^)]*\))?\s*,?\s+(?:{VERBS})\b"
#: A verb of speech with its subject (group 1), with the subject before it (group 2), or with another one (neither).
SPEECH = rf"(?U){NAMED}|(\b(?:{GOES_ON})\s*,?\s+)(?:{VERBS})\b|\b(?:{VERBS})\b"
_WORD = rf"(?:\p{{Lu}}[^\s“”\"]*|(?i:{NAME_LINKS}))"
#: Quotations in order; group 1 is empty where one isn't speech: a name, a description, a short name behind a preposition.
SPOKEN = rf"(?U)(?<=(?:{NOT_SPEECH})\s?)[“\"][^“”\"]+[”\"]|(?<=\b(?:{BEFORE_A_NAME})\s?)[“\"]\s*(?:{_WORD}(?:\s+{_WORD}){{0,3}}\s*)?[”\"]|{QUOTATION}"
TALK = rf"(?U){RUN}{NAME}\s+(?:{VERBS})\b"
CUT = "\x01"
FIELDS = ("tipo", "de", "para", "verbo", "texto", "data", "hora", "fuso", "lado", "numero", "citacoes", "falas", "conversa", "trecho")


def _with(x: Column, old: Sequence[str], **new: Column) -> Column:
    return F.struct(*(x[k].alias(k) for k in old if k not in new), *(v.alias(k) for k, v in new.items()))


def _raw(page: Column) -> Column:
    """Captions, titles and sentences of a page in order: (tipo, bruto). Footers are left out, broken lines joined."""
    lines = F.transform(F.split(F.translate(page, CUT, " "), r"\R|[\x1c-\x1e]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    text = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(FOOTER)), "\n")

    def parts(block: Column) -> Column:
        kind = F.when(block.rlike(rf"\A{CAPTION}"), "figura").when(block.rlike(rf"(?m)\A{TITLE}"), "secao")
        one = lambda t, k: F.struct(k.alias("tipo"), clean_ws(t).alias("bruto"))
        sentences = F.filter(F.split(F.replace(block, F.lit("\n"), F.lit(" ")), BREAK), lambda s: s.rlike(r"\S"))
        return let(kind, lambda k: F.when(k.isNotNull(), F.array(one(block, k))).otherwise(F.transform(sentences, lambda s: one(s, F.lit("relato")))))

    return F.flatten(F.transform(F.filter(F.split(F.regexp_replace(text, BLOCK, f"{CUT}$0{CUT}"), CUT), lambda b: b.rlike(r"\S")), parts))


def _masked(c: Column, omit: Sequence[str]) -> Column:
    for pattern in [*map(re.escape, omit), rf"\b(?:{SECTORS})\s+\d+[^“”\".;]*"]:
        c = F.regexp_replace(c, pattern, OMITTED)
    return mask_plate(mask_phone(mask_text(c)))


def _side(name: Column, owners: Sequence[str]) -> Column:
    plain = ["".join(c for c in unicodedata.normalize("NFD", o) if not unicodedata.combining(c)).upper() for o in owners]
    return F.when(name.isNull(), F.lit(None)).when(normalize_name(name).isin(plain), "enviada").otherwise("recebida")


def prose_items(page: Column, owners: Sequence[str] = (), omit: Sequence[str] = ()) -> Column:
    """A page's items, an array of structs of FIELDS; empty if the page tells of no conversation or is null.

    A sentence is a `mensagem` only if it reads: name, verb of speech, perhaps a receiver, and one quotation. Any other is a
    `relato`, whose quotations (`citacoes`) are said (`falas`) by `de` if one named subject alone speaks and does so before the
    first of them. `figura` is a caption, `secao` a title. Numbers of persons and phones, plates, capital addresses and the
    passages of `omit` are masked. Of quotations each is judged where it stands. U+0001 counts as a space.
    """
    prose = lambda x: x["tipo"] == "relato"
    figure = lambda x: x["tipo"] == "figura"
    bare = lambda c: F.btrim(c, F.lit("“”\""))
    group = lambda x, k: F.nullif(F.get(x["partes"], F.lit(k)), F.lit(""))

    def shown(x: Column) -> Column:
        return _with(x, ("tipo", "bruto"), texto=_masked(F.when(figure(x), F.regexp_extract(x["bruto"], r"^Figura \d+ [–\-] (.+)$", 1)).otherwise(x["bruto"]), omit))

    def matched(x: Column) -> Column:
        cut = F.regexp_replace(x["texto"], MESSAGE, CUT.join(f"${k}" for k in range(1, 8)))
        return _with(
            x, ("tipo", "texto"), trecho=F.when(figure(x), _masked(x["bruto"], omit)).otherwise(x["texto"]), numero=F.when(figure(x), F.regexp_extract(x["bruto"], r"^Figura (\d+)", 1).try_cast("bigint")),
            conversa=F.when(figure(x), x["texto"].rlike(TALK)), citacoes=F.when(prose(x), F.regexp_extract_all(x["texto"], F.lit(QUOTATION), F.lit(1))), partes=F.when(prose(x), F.split(cut, CUT)),
        )

    def told(x: Column) -> Column:
        names = [F.coalesce(bare(group(x, k)), F.lit("")) for k in (3, 5)]
        message = F.get(x["partes"], F.lit(6))
        others = F.filter(x["citacoes"], lambda q: ~q.isin(*names))
        return _with(x, ("texto", "trecho", "numero", "conversa", "citacoes", "partes"), tipo=F.when(prose(x) & (F.size(x["partes"]) == 7) & (others == F.array(message)), "mensagem").otherwise(x["tipo"]))

    def heard(x: Column) -> Column:
        spoken = F.filter(F.regexp_extract_all(x["texto"], F.lit(SPOKEN), F.lit(1)), lambda q: q != "")
        subjects = F.regexp_extract_all(x["texto"], F.lit(SPEECH), F.lit(1))
        goes_on = F.regexp_extract_all(x["texto"], F.lit(SPEECH), F.lit(2))
        return _with(
            x, ("tipo", "texto", "trecho", "numero", "conversa", "citacoes", "partes"), ditas=F.when(prose(x), spoken), nomes=F.when(prose(x), F.array_distinct(F.transform(F.filter(subjects, lambda s: s != ""), bare))),
            outro=F.when(prose(x), F.exists(F.zip_with(subjects, goes_on, lambda s, g: (s == "") & (g == "")), lambda o: o)),
        )

    def attributed(x: Column) -> Column:
        first = F.get(x["ditas"], F.lit(0))
        at = F.least(*(F.nullif(F.position(F.concat(F.lit(q), first), x["texto"]), F.lit(0)) for q in "“\""))
        sure = prose(x) & ~x["outro"] & (F.size(x["nomes"]) == 1) & first.isNotNull()
        one = F.when(sure, F.when(F.regexp_instr(x["texto"], F.lit(f"(?U){NAMED}")) <= at, F.get(x["nomes"], F.lit(0))))
        return let(one, lambda n: _with(x, ("tipo", "texto", "trecho", "numero", "conversa", "citacoes", "partes", "ditas"), fala=n))

    def final(x: Column) -> Column:
        sent = x["tipo"] == "mensagem"
        of = lambda k: F.when(sent, group(x, k))
        report = lambda c: F.when(prose(x), c)
        return let(
            F.when(sent, bare(group(x, 3))).otherwise(x["fala"]),
            lambda name: F.struct(
                x["tipo"].alias("tipo"), name.alias("de"), bare(of(5)).alias("para"), of(4).alias("verbo"), F.when(sent, F.trim(F.get(x["partes"], F.lit(6)))).otherwise(x["texto"]).alias("texto"),
                F.regexp_replace(of(0), r"(\d+)/(\d+)/(\d+)", "$3-$2-$1").alias("data"), of(1).alias("hora"), of(2).alias("fuso"), _side(name, owners).alias("lado"), x["numero"].alias("numero"),
                report(x["citacoes"]).alias("citacoes"), report(F.when(name.isNotNull(), x["ditas"]).otherwise(F.array().cast("array<string>"))).alias("falas"), x["conversa"].alias("conversa"), x["trecho"].alias("trecho"),
            ),
        )

    def talks(x: Column) -> Column:
        retold = prose(x) & ((F.size(x["falas"]) > 0) | ((F.size(x["citacoes"]) > 0) & x["texto"].rlike(TALK)))
        return (x["tipo"] == "mensagem") | F.coalesce(x["conversa"], F.lit(False)) | F.coalesce(retold, F.lit(False))

    items = _raw(F.coalesce(page, F.lit("")))
    for step in (shown, matched, told, heard, attributed, final):
        items = F.transform(items, step)
    return let(items, lambda found: F.when(F.exists(found, talks), found).otherwise(F.slice(found, 1, 0)))


def conversation_items(pages: DataFrame, owners: Sequence[str] = (), omit: Sequence[str] = ()) -> DataFrame:
    """(documento_id, pagina, ordem and FIELDS) of pages (documento_id, pagina, texto); see prose_items."""
    found = F.posexplode(prose_items(F.col("texto"), owners, omit)).alias("ordem", "item")
    return pages.select("documento_id", "pagina", found).select("documento_id", "pagina", "ordem", *(F.col(f"item.{k}").alias(k) for k in FIELDS))
