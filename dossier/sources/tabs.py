"""Case tabs, voting and bill JSON: raw captures to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import clean_ws, date_br, document_link, header_fields, is_placeholder, label_value_pairs, normalize_role, publicity, split_registration, try_date_br
from dossier.sources.markup import VOID, Scanner, cleaned

# The classes of a tab's parts, in the order (item, fields).
PARTS = {
    "andamentos": ("andamento-item", {"data": "andamento-data", "tipo": "andamento-nome", "descricao": "col-md-9", "docs": "andamento-docs", "explicacao": "hint-msg"}),
    "partes": ("processo-partes", {"papel": "detalhe-parte", "nome": "nome-parte"}),
    "peticoes": ("lista-dados", {"numero": "processo-detalhes-bold", "detalhe": "processo-detalhes"}),
    "deslocamentos": ("lista-dados", {"numero": "processo-detalhes-bold", "detalhe": "processo-detalhes"}),
}


class _Open:
    """An element that isn't closed yet, and the text in it, if it is wanted."""

    __slots__ = ("tag", "field", "text", "item", "mark")

    def __init__(self, tag: str, field: str | None = None, item: bool = False, mark: object = None) -> None:
        self.tag, self.field, self.item, self.mark = tag, field, item, mark
        self.text: list[str] = []


class _Page(Scanner):
    """Keeps the open elements; opened() says what a new one is, closed() takes a finished one."""

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.wanted: list[_Open] = []

    def opened(self, tag: str, own: dict[str, str], classes: list[str]) -> _Open:
        raise NotImplementedError

    def closed(self, element: _Open) -> None:
        raise NotImplementedError

    def start(self, tag: str, own: dict[str, str]) -> None:
        if tag == "li" and next((x.tag for x in reversed(self.stack) if x.tag in ("li", "ul", "ol")), None) == "li":
            self.end("li")  # an item ends the one before it in its list
        element = self.opened(tag, own, own["class"].split() if "class" in own else [])
        if tag in VOID:
            return
        self.stack.append(element)
        if element.field is not None:
            self.wanted.append(element)

    def end(self, tag: str) -> None:
        stack = self.stack
        if stack and stack[-1].tag == tag:
            self._pop()
        elif any(x.tag == tag for x in stack):
            while self._pop().tag != tag:
                pass

    def _pop(self) -> _Open:
        element = self.stack.pop()
        if element.field is not None and self.wanted and self.wanted[-1] is element:
            self.wanted.pop()
        self.closed(element)
        return element

    def data(self, text: str) -> None:
        for x in self.wanted:
            x.text.append(text)

    def read(self, content: bytes | None) -> _Page:
        self.feed(content.decode("utf-8", "replace") if content is not None else "")
        while self.stack:
            self._pop()
        return self


class _Tab(_Page):
    """For each element of an item class, the texts (and links) of elements of the field classes inside, as their elements end."""

    def __init__(self, item: str, fields: dict[str, str], within: str | None = None) -> None:
        super().__init__()
        self.item, self.fields, self.within = item, {c: n for n, c in fields.items()}, within
        self.items: list[list[dict[str, str | None]]] = []
        self.inside = self.holds = 0

    def opened(self, tag: str, own: dict[str, str], classes: list[str]) -> _Open:
        around = bool(self.within) and own.get("id") == self.within
        self.inside += around
        item = (self.inside > 0 or not self.within) and not self.holds and self.item in classes
        if item and tag not in VOID:
            self.holds += 1
            self.items.append([])
        field = next((self.fields[c] for c in classes if c in self.fields), None) if self.holds else None
        if tag == "a" and own.get("href") and any(x.field == "docs" for x in self.wanted):
            return _Open(tag, "link", item, own["href"])
        return _Open(tag, field, item, around)

    def closed(self, element: _Open) -> None:
        if element.field is not None:
            self.items[-1].append({"campo": element.field, "texto": cleaned(element.text), "href": element.mark if element.field == "link" else None})
        self.holds -= element.item
        self.inside -= element.mark is True


#: An element with none of the classes that count.
PLAIN = (False, False, False)


class _Leaves(_Page):
    """Of the header and information pages the texts that count, in the order in which their elements end: inputs by id, scripts, and
    the innermost divs of the information, among others."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict[str, str | None]] = []
        self.info = self.subjects = 0
        self.box: list[dict[str, str]] = []

    def opened(self, tag: str, own: dict[str, str], classes: list[str]) -> _Open:
        if tag == "input" and own.get("id"):
            self.found.append({"campo": "input", "texto": own["id"], "valor": own.get("value")})
        field = None
        if tag == "script":
            field = "script"
        elif own.get("id") in ("dados-processo", "descricao-procedencia"):
            field = own["id"]
        elif self.subjects and tag == "li":
            field = "assunto"
        elif self.box and ("rotulo" in classes or "numero" in classes):
            field = "rotulo" if "rotulo" in classes else "numero"
        elif self.info and tag == "div":
            field = "div"
        if tag == "div" and self.stack:
            self.stack[-1].item = True  # it holds a div, so it is no leaf
        if not classes:
            return _Open(tag, field, False, PLAIN)
        names = ("processo-informacoes" in classes, "informacoes__assunto" in classes, "processo-quadro" in classes)
        self.info += names[0]
        self.subjects += names[1]
        if names[2] and tag not in VOID:
            self.box.append({})
        return _Open(tag, field, False, names)

    def closed(self, element: _Open) -> None:
        info, subjects, box = element.mark
        self.info -= info
        self.subjects -= subjects
        if element.field in ("rotulo", "numero") and self.box:
            self.box[-1].setdefault(element.field, cleaned(element.text))
        inner = element.tag == "div" and not element.item and (self.info or info)
        if element.field not in (None, "rotulo", "numero", "div"):
            said = "".join(element.text) if element.field == "script" else cleaned(element.text)
            self.found.append({"campo": element.field, "texto": said, "valor": None})
        if inner and element.field is not None and self.info:
            self.found.append({"campo": "div", "texto": cleaned(element.text), "valor": None})
        if box:
            own = self.box.pop()
            self.found.append({"campo": "quadro", "texto": own.get("rotulo", ""), "valor": own.get("numero", "")})


def _parsed(snapshots: DataFrame, tab: str, kind: str, read: Callable[[bytes | None], list]) -> DataFrame:
    """(sid, incidente, itens): a page in one row, so that its parts never leave it. snapshots: (sid, incidente, aba, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = pa.array([read(x.as_py()) for x in b.column("content")], kinds)
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("incidente"), items], names=["sid", "incidente", "itens"])

    cell = pa.struct([(n, pa.string()) for n in ("campo", "texto", kind)])
    kinds = pa.list_(pa.list_(cell)) if kind == "href" else pa.list_(cell)
    shape = f"struct<campo:string,texto:string,{kind}:string>"
    chosen = snapshots.where(F.col("aba") == tab).select(F.col("sid").cast("bigint"), F.col("incidente").cast("bigint"), F.col("content").cast("binary").alias("content"))
    return chosen.mapInArrow(run, f"sid bigint, incidente bigint, itens {f'array<array<{shape}>>' if kind == 'href' else f'array<{shape}>'}")


def tab_items(snapshots: DataFrame, tab: str) -> DataFrame:
    """(sid, incidente, bloco, x) of a tab's items in page order; x: array of (campo, texto, href) in the order of the page."""
    item, fields = PARTS[tab]
    within = "todas-partes" if tab == "partes" else None
    got = _parsed(snapshots, tab, "href", lambda content: _Tab(item, fields, within).read(content).items)
    return got.select("sid", "incidente", F.posexplode("itens").alias("bloco", "x"))


def _all(name: str, of: str = "x") -> Column:
    """The texts of a field."""
    return F.transform(F.filter(of, lambda x: x["campo"] == name), lambda x: x["texto"])


def _field(name: str) -> Column:
    return F.array_max(_all(name))


def parse_events(snapshots: DataFrame, tab: str = "andamentos", base: str = "https://portal.example/") -> DataFrame:
    """(sid, incidente, posicao, data, tipo, descricao, documentos, explicacao_portal)."""
    got = tab_items(snapshots.where(F.col("aba") == tab).withColumn("aba", F.lit("andamentos")), "andamentos")

    def linked(x: Column) -> Column:
        d = document_link(x["href"], base)
        return F.struct(x["texto"].alias("rotulo"), d["endpoint"].alias("endpoint"), d["id_portal"].alias("id_portal"), d["formato"].alias("formato"), d["url"].alias("url"))

    docs = F.transform(F.filter("x", lambda x: x["campo"] == "link"), linked)
    return got.select("sid", "incidente", F.col("bloco").alias("posicao"), date_br(_field("data")).alias("data"), _field("tipo").alias("tipo"), F.coalesce(_field("descricao"), F.lit("")).alias("descricao"), docs.alias("documentos"), F.nullif(_field("explicacao"), F.lit("")).alias("explicacao_portal"))


def parse_parties(snapshots: DataFrame) -> DataFrame:
    """(sid, incidente, bloco, posicao, papel_portal, papel, nome, oab, e_placeholder): the k-th role of a block goes with its k-th name."""
    blocks = tab_items(snapshots, "partes").select("sid", "incidente", "bloco", _all("papel").alias("p"), _all("nome").alias("n"))
    bad = F.raise_error(F.lit("a block has other numbers of roles and names")).cast("array<struct<p:string,n:string>>")
    rows = blocks.select("sid", "incidente", "bloco", F.posexplode(F.when(F.size("p") == F.size("n"), F.arrays_zip("p", "n")).otherwise(bad)).alias("posicao", "x"))
    named = rows.withColumn("s", split_registration(F.col("x.n")))
    return named.select("sid", "incidente", "bloco", "posicao", F.col("x.p").alias("papel_portal"), normalize_role(F.col("x.p")).alias("papel"), F.col("s.nome").alias("nome"), F.col("s.oab").alias("oab"), is_placeholder(F.col("s.nome")).alias("e_placeholder"))


def parse_details(snapshots: DataFrame, tab: str) -> DataFrame:
    """(sid, incidente, posicao, numero, detalhe) of petitions or movements; see petition_details and movement_details."""
    return tab_items(snapshots, tab).select("sid", "incidente", F.col("bloco").alias("posicao"), _field("numero").alias("numero"), F.array_join(_all("detalhe"), " ").alias("detalhe"))


# The tabs by name, what the header's script says to load them, a case's class and number.
TAB_NAMES = ("Partes", "Andamentos", "Informacoes", "Decisoes", "Sessao", "Deslocamentos", "Peticoes", "Recursos", "Pautas")
LOADED = r"""(?:\$\.get\(|\.load\()\s*['"](aba([A-Za-z]+)\.asp\?[^'"]*)['"]"""
CASE = r"^\s*([A-Za-z]+)\s+(\d+)\s*$"


def parse_information(snapshots: DataFrame) -> DataFrame:
    """(sid, incidente, assuntos, data_protocolo, orgao_origem, origem, numeros_origem, descricao_procedencia, volumes, folhas).

    Labels and values are the innermost divs, in order (see label_value_pairs). A day that isn't one is an error.
    """
    got = _parsed(snapshots, "informacoes", "valor", lambda content: _Leaves().read(content).found)
    rows = got.withColumn("pares", label_value_pairs(_all("div", "itens")))
    value = lambda name: F.try_element_at("pares", F.lit(name))
    box = lambda name: F.get(F.reverse(F.filter("itens", lambda x: (x["campo"] == "quadro") & (x["texto"] == name))), F.lit(0))["valor"]
    number = lambda c: F.when(c.rlike(r"^\d+$"), c.cast("int"))
    numbers = F.filter(F.transform(F.split(F.coalesce(value("Número de Origem"), F.lit("")), ","), clean_ws), lambda x: x != "")
    return rows.select(
        "sid", "incidente", F.filter(_all("assunto", "itens"), lambda x: x != "").alias("assuntos"), date_br(value("Data de Protocolo")).alias("data_protocolo"), value("Órgão de Origem").alias("orgao_origem"), value("Origem").alias("origem"),
        numbers.alias("numeros_origem"), F.nullif(F.get(_all("descricao-procedencia", "itens"), F.lit(0)), F.lit("")).alias("descricao_procedencia"), number(box("Volumes")).alias("volumes"), number(box("Folhas")).alias("folhas"),
    )


def parse_header(snapshots: DataFrame) -> DataFrame:
    """(sid, incidente, classe, numero, publicidade, meio, peca, abas and what header_fields gives): the header page, abas being the
    addresses (nome, url) that its script loads, the first of each tab.

    A page without the case's id, or whose class and number can't be read, is an error.
    """
    got = _parsed(snapshots, "casca", "valor", lambda content: _Leaves().read(content).found)
    value = lambda name: F.get(F.filter("itens", lambda x: (x["campo"] == "input") & (x["texto"] == name)), F.lit(0))["valor"]
    rows = got.withColumns({"caso": value("classe-numero-processo"), "id": value("incidente"), "meio": value("meio"), "peca": value("peca"), "script": F.array_join(_all("script", "itens"), "\n")})
    rows = rows.withColumn("dados", header_fields(F.coalesce(F.get(_all("dados-processo", "itens"), F.lit(0)), F.lit(""))))
    valid = (F.coalesce("id", F.lit("")) != "") & F.coalesce(F.col("caso").rlike(CASE), F.lit(False))
    found = F.arrays_zip(F.regexp_extract_all("script", F.lit(LOADED), F.lit(1)).alias("url"), F.regexp_extract_all("script", F.lit(LOADED), F.lit(2)).alias("nome"))
    rows = rows.withColumn("lidas", F.filter(found, lambda x: x["nome"].isin(*TAB_NAMES)))
    first = F.filter("lidas", lambda x, i: F.array_position(F.col("lidas.nome"), x["nome"]) == i + 1)
    named = F.transform(first, lambda x: F.struct(F.lower(x["nome"]).alias("nome"), F.when((x["nome"] == "Sessao") & F.endswith(x["url"], F.lit("&tema=")), F.concat(x["url"], F.lit("N"))).otherwise(x["url"]).alias("url")))
    case = F.when(valid, F.col("id").cast("bigint")).otherwise(F.raise_error(F.lit("no header of a case")).cast("bigint"))
    return rows.select("sid", case.alias("incidente"), F.regexp_extract("caso", CASE, 1).alias("classe"), F.regexp_extract("caso", CASE, 2).cast("bigint").alias("numero"), publicity(F.col("script")).alias("publicidade"), "meio", "peca", named.alias("abas"), "dados.*")


# ------------------------------------------------------------ nested JSON


def described(v: Column) -> Column:
    """A value that is an object with descricao, or the text itself."""
    return F.coalesce(F.try_variant_get(v, "$.descricao", "string"), F.try_variant_get(v, "$", "string"))


def parse_session_objects(json_df: DataFrame) -> DataFrame:
    """(sid, objeto_id, identificacao, identificacao_completa, tipo, principal_id, pai_id) of captures (sid, value)."""
    v = json_df.select("sid", F.explode(F.from_json("value", "array<string>")).alias("o")).select("sid", F.try_parse_json(F.col("o")).alias("v"))
    get = lambda p, t: F.try_variant_get("v", f"$.objetoIncidente.{p}", t)
    return v.select("sid", get("id", "bigint").alias("objeto_id"), get("identificacao", "string").alias("identificacao"), get("identificacaoCompleta", "string").alias("identificacao_completa"), F.coalesce(get("tipoObjetoIncidente.descricao", "string"), get("tipoObjetoIncidente", "string")).alias("tipo"), get("principal.id", "bigint").alias("principal_id"), get("pai.id", "bigint").alias("pai_id"))


def parse_session_lists(json_df: DataFrame) -> DataFrame:
    """(sid, objeto_id, lista_id, nome, julgado, relator, tipo, sessao_*, votos) of captures (sid, value); bad numbers and days are null."""
    v = json_df.select("sid", F.explode(F.from_json("value", "array<string>")).alias("o")).select("sid", F.try_parse_json(F.col("o")).alias("v"))
    lists = v.select("sid", F.try_variant_get("v", "$.objetoIncidente.id", "bigint").alias("objeto_id"), F.explode(F.try_variant_get("v", "$.listasJulgamento", "array<variant>")).alias("l"))
    get = lambda p, t="string": F.try_variant_get("l", f"$.{p}", t)
    text = lambda p: F.coalesce(get(f"{p}.descricao"), get(p))
    vote = lambda x, p, t="string": F.try_variant_get(x, f"$.{p}", t)
    votes = F.transform(get("votos", "array<variant>"), lambda x: F.struct(vote(x, "numeroOrdemVotoSessao", "bigint").alias("ordem"), F.coalesce(vote(x, "ministro.descricao"), vote(x, "ministro")).alias("ministro"), try_date_br(vote(x, "dataVoto")).alias("data"), F.coalesce(vote(x, "tipoVoto.descricao"), vote(x, "tipoVoto")).alias("tipo"), F.coalesce(vote(x, "acompanhandoMinistro.descricao"), vote(x, "acompanhandoMinistro")).alias("acompanha")))
    return lists.select("sid", "objeto_id", get("id", "bigint").alias("lista_id"), get("nomeLista").alias("nome"), get("julgado", "boolean").alias("julgado"), text("ministroRelator").alias("relator"), text("tipoListaJulgamento").alias("tipo"), text("sessao.colegiado").alias("colegiado"), get("sessao.numero", "bigint").alias("sessao_numero"), get("sessao.ano", "int").alias("sessao_ano"), try_date_br(get("sessao.dataInicio")).alias("inicio"), try_date_br(get("sessao.dataFim")).alias("fim"), text("tipoResultadoJulgamento").alias("resultado"), votes.alias("votos"))


def parse_bills(json_df: DataFrame) -> DataFrame:
    """(sid, casa, codigo, sigla, numero, ano, ementa, autor, data) of two legislatures' answers (sid, casa, value).

    The first gives one object or a list of them; numbers that aren't all digits are null; a day is the first ten characters.
    """
    v = json_df.select("sid", "casa", F.try_parse_json(F.col("value")).alias("v"))
    many = F.try_variant_get("v", "$.PesquisaBasicaMateria.Materias.Materia", "array<variant>")
    one = F.array(F.try_variant_get("v", "$.PesquisaBasicaMateria.Materias.Materia", "variant"))
    items = F.coalesce(many, F.try_variant_get("v", "$.dados", "array<variant>"), one)
    rows = v.select("sid", "casa", F.explode(items).alias("i")).where("i is not null")
    get = lambda *ps: F.coalesce(*(F.try_variant_get("i", f"$.{p}", "string") for p in ps))
    number = lambda c: F.when(c.rlike(r"^\d+$"), c.cast("bigint"))
    return rows.select("sid", "casa", get("Codigo", "id").alias("codigo"), get("Sigla", "siglaTipo").alias("sigla"), number(get("Numero", "numero")).alias("numero"), number(get("Ano", "ano")).alias("ano"), clean_ws(get("Ementa", "ementa")).alias("ementa"), get("Autor").alias("autor"), F.to_date(F.try_to_timestamp(F.substring(get("Data", "dataApresentacao"), 1, 10), F.lit("yyyy-MM-dd"))).alias("data")).where("codigo is not null")
