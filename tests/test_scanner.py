"""The scanner's parts of a page, and what it costs."""

from dossier.sources import markup, tabs


class Parts(markup.Scanner):
    def __init__(self):
        self.found = []

    def start(self, tag, own):
        self.found.append((tag, dict(own)))

    def end(self, tag):
        self.found.append("/" + tag)

    def data(self, text):
        self.found.append(text)


def parts(page):
    (p := Parts()).feed(page)
    return p.found


def test_parts_in_order():
    long = "x" * 300
    page = f'a &amp; b<!-- <p> --><DIV Class="x &lt; y" id=z>1 &lt; 2</DIV><script>if (a<b) "<p>"</Script><br/><i title="{long}">t</i> < c'
    assert parts(page) == ["a & b", ("div", {"class": "x < y", "id": "z"}), "1 < 2", "/div", ("script", {}), 'if (a<b) "<p>"', "/script", ("br", {}), ("i", {"title": long}), "t", "/i", " < c"]
    assert parts("<style>a<b") == [("style", {}), "a<b"]


def test_attributes_that_pages_repeat_are_read_once():
    markup.attributes.cache_clear()
    page = '<div class="processo-informacoes"><div class="col">Origem:</div><div class="col">DF</div></div>'.encode()
    found = [tabs._Leaves().read(page).found for _ in range(50)]
    assert found == [[{"campo": "div", "texto": "Origem:", "valor": None}, {"campo": "div", "texto": "DF", "valor": None}]] * 50
    assert markup.attributes.cache_info().misses == 2
