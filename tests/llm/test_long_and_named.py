"""Words of any length are encoded as the reference tokenizer does; articles under misleading names stay."""

import random

import pytest

from dossier.llm import bpe, html

PAGE = '<html><body><nav>Home About</nav><div class="{0}"><h1>Title of it</h1><p>A long article, with words. And more words, as they come.</p><p>Second paragraph, also long enough to count. Yes.</p><div class="ad">Buy now, today.</div></div>{1}<footer>(c)</footer></body></html>'
TEXT = "Title of it\nA long article, with words. And more words, as they come.\nSecond paragraph, also long enough to count. Yes."


@pytest.mark.parametrize("name", ["share-story", "search", "copyright-law-article", "notice-of-appeal", "story", "promo widget"])
def test_articles_under_misleading_names(name):
    assert html.main_text(PAGE.format(name, "")) == TEXT
    assert html.main_text(PAGE.format(name, '<div class="comments"><p>Nice.</p></div>')) == TEXT


def test_names_still_drop_what_is_less():
    """Comments longer than the article go while a tenth of the text is left; a page of nothing but adverts gives nothing."""
    comments = '<div class="comments">' + "<p>I think so too, and so do others here, you know.</p>" * 20 + "</div>"
    assert html.main_text(PAGE.format("story", comments)) == TEXT
    assert html.main_text('<div class="ads"><div class="ad"><p>Buy.</p></div><div class="ad"><p>Buy.</p></div></div><form><p>Send it now, please.</p></form>') in ("", "Buy.\nBuy.")
    assert html.main_text("<nav>Home</nav>") == ""


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers
    import tiktoken

    coder = bpe.Coder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coder, tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def ids(coder, text):
    return [int(x) for pieces in coder.encode([text]) for p in pieces for x in coder.known[p][0].split(",")]


@pytest.mark.parametrize("letters", ["a", "ab", "abé日", "the", "".join(map(chr, range(97, 123))), "".join(map(chr, range(0x4E00, 0x5E00)))])
@pytest.mark.parametrize("n", [bpe.HUGE // 4, bpe.HUGE - 1, bpe.HUGE, 50_000])
def test_huge_words(coders, letters, n):
    coder, known = coders
    word = "".join(random.Random(n).choices(letters, k=n))
    if n < bpe.HUGE and len(letters) > 4:
        word = word[:2000]
    assert ids(coder, word) == known.encode_ordinary(word)


def test_a_million_letters(coders):
    coder = coders[0]
    for word in ("a" * 1_000_000, "".join(random.Random(1).choices("abcdefgh", k=1_000_000))):
        (pieces,) = coder.encode([word])
        assert b"".join(coder.known[p][2] for p in pieces) == word.encode()
