import hashlib
import zlib

import numpy as np
import pytest

from harrow.llm import media
from harrow.llm.html_text import extract, main_text

from .samples import awkward, nothing, rows_of


def test_payloads_come_back(spark):
    docs = awkward(spark, ["z" * 576, "z" * 577, "ÿ" * 288])
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows_of(docs)}
    got = rows_of(media.media_digests(docs))
    assert len(got) == docs.count()
    for r in got:
        data = texts[r["doc_id"]]
        payload = data + b"\xff" * (max(-(-len(data) // 576), 1) * 576 - len(data))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        stored = media.store_payload(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.media_digests(nothing(spark)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000])
def test_fast_and_general_decoders_agree(size):
    data = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    frames = media.read_avi(media.store_payload(data)).frames
    for frame, (blocks, samples) in zip(frames, media.decode_frames(frames), strict=True):
        slow_blocks, slow_samples = media.decode_frame(frame)
        assert (blocks == slow_blocks).all() and (samples == slow_samples).all()


def test_shots_and_clips(spark):
    dark, light = np.full(576, 10, np.uint8), np.full(576, 240, np.uint8)
    assert media.shots([dark] * 3 + [light] * 2) == [(0, 3), (3, 5)]
    assert media.shots([]) == []
    files = [(1, media.store_payload(b"a" * 2000)), (2, None), (3, b""), (4, b"RIFF nonsense")]
    got = rows_of(media.clips(spark.createDataFrame(files, "id long, media binary"), "id", "media"))
    assert {r["id"] for r in got} == {1} and got[-1]["end_s"] == pytest.approx(4 / media.FPS)


PAGE = """<html><head><title>No</title><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, many, many of them.</p></div>
<article><h1>Head &amp; line</h1><p>First   paragraph, with commas, and
enough text to be counted &#8211; really.</p><p>Second <b>paragraph</b>, which is long enough as well, one hopes.</p>
<aside><p>Related things, to read, elsewhere.</p></aside></article>
<div id="comments"><p>I disagree, strongly, with all of this.</p></div><footer><p>Imprint, contact</p></footer></body></html>"""


def test_the_article_alone():
    assert main_text(PAGE) == (
        "Head & line\n\nFirst paragraph, with commas, and enough text to be counted – really.\n\n"
        "Second paragraph, which is long enough as well, one hopes."
    )


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<p>", "</div>", "<!-- open", "<script>x", "<a href='", "&#xZZ;", "<p>" * 3000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(main_text(page), str)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = rows_of(extract(pages))
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert next(r["text"] for r in got if r["page_id"] is None) == ""
