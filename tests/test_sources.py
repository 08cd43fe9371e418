"""Files: listings, headers, metadata, sound, portable documents, and settling streams."""

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumencat.sources import files, generation, images, pcm, portable
from lumencat.streaming import watch


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(w, h, colour=6, *chunks):
    return images.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + b"".join(chunks) + chunk(b"IEND", b"")


def test_headers():
    assert images.header(png(3, 4))["alpha"] is True
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 9) + b"\0" * 12
    assert (images.header(jpeg)["width"], images.header(jpeg)["height"]) == (9, 7)
    vp8x = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert images.header(vp8x) == {"format": "webp", "width": 100, "height": 50, "alpha": True, "orientation": 1, "profile": False, "error": None}
    turned = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 1) + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0) + b"\0" * 4
    body = b"Exif\0\0" + turned
    icc = b"\xff\xe2" + struct.pack(">H", 16) + b"ICC_PROFILE\0\1\1"
    got = images.header(jpeg[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + icc + jpeg[2:])
    assert (got["width"], got["height"], got["orientation"], got["profile"]) == (7, 9, 6, True)
    got = images.header(png(3, 4, 6, chunk(b"iCCP", b"x"), chunk(b"eXIf", turned)))
    assert (got["width"], got["height"], got["profile"]) == (4, 3, True)
    for bad in (b"", b"GIF89a", png(0, 1), png(3, 4)[:17], b"\xff\xd8\xff"):
        assert images.header(bad)["error"]
    assert images.header(None)["error"] is None


def text_chunk(key, text):
    return chunk(b"tEXt", key.encode() + b"\0" + text.encode("latin-1"))


def claims(*chunks):
    return generation.extract(png(1, 1, 6, *chunks))


def composed(prompt, negative, pairs):
    """A settings text put together from its parts; values with a comma, colon or quote are quoted."""
    quoted = lambda v: '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if set(v) & set(',:"') else v
    rest = ", ".join(f"{k}: {quoted(v)}" for k, v in pairs.items())
    return "".join([f"{prompt}\n" * (prompt is not None), f"Negative prompt: {negative}\n" * (negative is not None), rest])


@pytest.mark.parametrize("seed", range(40))
def test_settings_texts_read_back_as_they_were_put_together(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcxyz 0.-_()<>éß\\") for _ in range(r.randrange(1, 12))).strip() or "w"
    value = lambda: r.choice([word(), f"{word()}, {word()}", f'{word()}: "{word()}"', str(r.randrange(10**r.randrange(1, 25)))])
    prompt = r.choice([None, word(), f"{word()}\n\n{word()}: {word()}", f"{word()}, {word()}"])
    negative = r.choice([None, "", word(), f"{word()}\n{word()}"])
    pairs = {"Steps": str(r.randrange(1, 99))} | {f"Option {k}": value() for k in range(r.randrange(5))}
    named = {"Seed": str(r.randrange(1 << 70)), "Sampler": word(), "Model": value(), "Model hash": f"{r.randrange(1 << 32):08x}"}
    chosen = {k: v for k, v in named.items() if r.random() < 0.6}
    c = generation.sidecar(composed(prompt, negative, pairs | chosen))["claims"][0]
    assert (c["prompt"], c["negative_prompt"]) == (prompt and prompt.strip() or None, negative)
    assert (c["seed"], c["sampler"], c["model"]) == tuple(chosen.get(k) for k in ("Seed", "Sampler", "Model"))
    assert c["settings"] == {k: v.strip() for k, v in pairs.items()}
    assert [x["value"] for x in c["references"]] == [v for k, v in chosen.items() if k == "Model hash"]


def test_text_chunks_of_every_kind():
    text = composed("old mill by the river", "people", {"Steps": "31", "Seed": "12"})
    plain, packed = text.encode("latin-1"), zlib.compress(text.encode("latin-1"))
    kinds = {
        chunk(b"tEXt", b"parameters\0" + plain): "png_text", chunk(b"zTXt", b"parameters\0\0" + packed): "png_text",
        chunk(b"iTXt", b"parameters\0\0\0en\0title\0" + plain): "png_itext", chunk(b"iTXt", b"parameters\0\1\0\0\0" + packed): "png_itext",
    }
    for data, container in kinds.items():
        got = claims(data)
        assert got["issues"] == [] and [(c["container"], c["prompt"], c["seed"]) for c in got["claims"]] == [(container, "old mill by the river", "12")]
    both = claims(*kinds)["claims"]
    assert len(both) == 4
    assert claims(chunk(b"tEXt", b"Author\0" + plain), chunk(b"fdAT", b"parameters\0" + plain))["claims"] == []
    assert generation.sidecar(None)["status"] == generation.sidecar("just a note")["status"] == "none"


def test_what_is_too_large_or_broken_is_an_issue():
    inflated = generation.MAX_INFLATED_BYTES
    assert claims(chunk(b"iTXt", b"parameters\0\1\0\0\0" + zlib.compress(b"0" * (inflated + 1))))["issues"][0]["code"] == "limit"
    wordy = claims(text_chunk("parameters", composed("w" * (generation.MAX_PROMPT_BYTES + 7), None, {"Steps": "5", "Sampler": "heun"})))
    assert wordy["claims"][0]["prompt"] is None and wordy["claims"][0]["sampler"] == "heun" and wordy["issues"][0]["field"] == "prompt"
    crowd = claims(*[text_chunk(f"note {k}", "n") for k in range(generation.MAX_SEGMENTS)], text_chunk("parameters", "never\nSteps: 1"))
    assert crowd["claims"] == [] and {i["code"] for i in crowd["issues"]} == {"limit"}
    whole = text_chunk("parameters", "kept\nSteps: 8")
    for k in range(4):  # one byte of the check sum
        damaged = whole[: -1 - k] + bytes([whole[-1 - k] ^ 0x40]) + whole[len(whole) - k :]
        got = claims(damaged, text_chunk("parameters", "kept\nSteps: 9"))
        assert [c["settings"]["Steps"] for c in got["claims"]] == ["9"] and got["issues"][0]["code"] == "malformed"
    for text in ("", "null", "7", '{"a": ', '{"a": 1}}'):
        assert claims(text_chunk("prompt", text))["issues"][0]["code"] == "malformed"
    nested = '{"a":' * (generation.MAX_JSON_DEPTH + 1) + "1" + "}" * (generation.MAX_JSON_DEPTH + 1)
    assert claims(text_chunk("prompt", nested))["issues"][0]["code"] == "limit"
    assert generation.extract(None)["status"] == generation.extract(b"plain bytes")["status"] == "none"
    cut = png(2, 2, 2, whole)
    assert {generation.extract(cut[:k])["status"] for k in range(45, len(cut) - 13)} == {"malformed"}


def drawn(**nodes):
    """The claims of a node graph; a node is (kind, inputs), and an input ">name" is a link."""
    link = lambda v: [v[1:], 0] if isinstance(v, str) and v.startswith(">") else v
    graph = {k: {"class_type": kind, "inputs": {n: link(v) for n, v in inputs.items()}} for k, (kind, inputs) in nodes.items()}
    return claims(text_chunk("prompt", json.dumps(graph)))


SAMPLER = {"seed": 5, "sampler_name": "dpm", "positive": ">near", "model": ">base"}


def test_a_prompt_is_the_text_of_the_node_that_is_linked():
    far = {"join": ("Join", {"a": ">mark", "b": ">deep"}), "mark": ("Encode", {"text": "watermark label"}), "deep": ("Join", {"c": ">real"}), "real": ("Encode", {"text": "a lighthouse at dusk"})}
    got = drawn(s=("KSampler", SAMPLER | {"positive": ">join"}), **far)
    assert got["claims"][0]["prompt"] is None and got["claims"][0]["seed"] == "5" and got["issues"] == []
    got = drawn(s=("KSampler", SAMPLER), near=("Encode", {"text": "a lighthouse", "clip": ">mark"}), mark=("Encode", {"text": "watermark label"}))
    assert got["claims"][0]["prompt"] == "a lighthouse"
    assert drawn(s=("KSampler", SAMPLER), near=("Wide", {"text_g": "both", "text_l": "small"}))["claims"][0]["prompt"] == "both"
    assert drawn(s=("KSampler", SAMPLER), near=("Encode", {"text": ">typed"}), typed=("Text", {"text": "typed"}))["claims"][0]["prompt"] is None
    assert drawn(s=("KSampler", SAMPLER | {"negative": ">nowhere"}))["claims"][0]["negative_prompt"] is None


def test_models_and_layers_are_those_of_the_chain():
    chain = {"base": ("Layer", {"lora_name": "ink", "model": ">mid", "clip": ">other"}), "mid": ("Patch", {"model": ">load"}), "load": ("UNETLoader", {"unet_name": "flux", "model": ">more"})}
    beside = {"more": ("Layer", {"lora_name": "behind the loader"}), "other": ("Layer", {"lora_name": "of the clip"}), "spare": ("CheckpointLoader", {"ckpt_name": "spare"})}
    c = drawn(s=("KSamplerAdvanced", SAMPLER), **chain, **beside)["claims"][0]
    assert c["model"] == "flux" and [(r["kind"], r["value"]) for r in c["references"]] == [("lora", "ink")]
    ring = drawn(s=("KSampler", SAMPLER), base=("Layer", {"lora_name": "ink", "model": ">s"}))["claims"][0]
    assert ring["model"] is None and [r["value"] for r in ring["references"]] == ["ink"]
    hops = {f"n{k}": ("Patch", {"model": f">n{k + 1}"}) for k in range(generation.MAX_GRAPH_HOPS)} | {f"n{generation.MAX_GRAPH_HOPS}": ("Loader", {"ckpt_name": "too far"})}
    assert drawn(s=("KSampler", SAMPLER | {"model": ">n0"}), **hops)["claims"][0]["model"] is None
    seen = drawn(s=("KSampler", SAMPLER), base=("LoadImage", {"image": "/home/u/ref.png"}), p=("PreviewImage", {"image": "no"}))["claims"][0]
    assert [(r["kind"], r["private"]) for r in seen["references"]] == [("image", True)]


def test_other_kinds_are_no_samplers_and_two_are_ambiguous():
    got = drawn(a=("KSamplerSelect", {"sampler_name": "x"}), b=("MyKSampler", {"seed": 2}), m=("Loader", {"ckpt_name": "only"}))
    assert (got["claims"][0]["model"], got["claims"][0]["sampler"], got["issues"]) == ("only", None, [])
    got = drawn(a=("KSampler", SAMPLER), b=("KSamplerAdvanced", SAMPLER), m=("Loader", {"ckpt_name": "x"}), n=("Loader", {"ckpt_name": "x"}))
    assert got["claims"] == [] and [(i["code"], i["field"]) for i in got["issues"]] == [("ambiguous", "prompt")]
    linked = drawn(s=("KSampler", SAMPLER | {"seed": ">number", "noise_seed": 8, "steps": ">number", "cfg": 3}), number=("Int", {"value": 4}))["claims"][0]
    assert linked["seed"] == "8" and linked["settings"] == {"cfg": "3"}
    assert drawn(**{f"n{k}": ("X", {}) for k in range(generation.MAX_GRAPH_NODES + 1)})["status"] == "limit"
    assert claims(text_chunk("prompt", json.dumps({"1": 5, "2": {"class_type": "KSampler", "inputs": [1]}})))["claims"] == []


def test_objects_of_names_and_values():
    said = {"positive_prompt": "glass tower", "negative_prompt": "fog", "seed": 10**20, "model": {"model_name": "alpha", "hash": "h9"}, "steps": 12, "width": 640, "app_version": "6"}
    c = claims(text_chunk("invokeai_metadata", json.dumps(said)))["claims"][0]
    assert (c["prompt"], c["negative_prompt"], c["seed"], c["model"], c["generator"]) == ("glass tower", "fog", str(10**20), "alpha", "InvokeAI 6")
    assert c["settings"] == {"steps": "12", "width": "640"} and [r["value"] for r in c["references"]] == ["h9"]
    got = claims(text_chunk("invokeai_metadata", json.dumps(said | {"seed": 2.0, "model": "beta"})))
    assert got["claims"][0]["seed"] is None and got["claims"][0]["model"] == "beta" and got["issues"][0]["code"] == "inexact"
    comment = text_chunk("Comment", '{"prompt": "a ferry", "uc": "blur", "seed": 3, "scale": 5.5}')
    c = claims(text_chunk("Software", "NovelAI"), text_chunk("Source", "engine 7"), comment)["claims"]
    assert [(x["prompt"], x["negative_prompt"], x["model"], x["settings"]) for x in c] == [("a ferry", "blur", "engine 7", {"scale": "5.5"})]
    assert claims(text_chunk("Software", "an editor"), comment)["claims"] == []
    beside = claims(text_chunk("Software", "a tool 2"), text_chunk("parameters", "sea\nSteps: 2"))["claims"]
    assert [x["generator"] for x in beside] == [None, "a tool 2"]


def test_sound_headers_without_bits_are_errors(spark):
    good = pcm.wav_bytes(np.zeros(4), 8000)
    none = good[:34] + b"\0\0" + good[36:]  # bits a sample
    rows = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(none)), ("c", bytearray(good[:-2])), ("d", None)], "path string, content binary")
    errors = {r["path"]: r["error"] for r in pcm.frames(rows).select("path", "error").distinct().collect()}
    assert errors["a"] is None and errors["b"] and errors["c"] and errors["d"]


def tiff(order, tags, sub):
    """A TIFF block with two directories; values stand behind them."""
    head = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", 8)
    first = 2 + 12 * (len(tags) + 1) + 4
    second = 8 + first
    at = second + 2 + 12 * len(sub) + 4
    out, data = b"", b""
    for entries, more in ((tags, True), (sub, False)):
        out += struct.pack(order + "H", len(entries) + more)
        for tag, kind, value in entries:
            out += struct.pack(order + "HHII", tag, kind, len(value), at + len(data))
            data += value
        if more:
            out += struct.pack(order + "HHII", 0x8769, 4, 1, second)
        out += struct.pack(order + "I", 0)
    return head + out + data


def test_exif_and_xmp():
    comment = b"UNICODE\0" + "a 🦊 fox\nSteps: 20, Seed: 42".encode("utf-16-be")
    blob = tiff(">", [(0x0131, 2, b"Some tool\0")], [(0x9286, 7, comment), (0x9003, 2, b"2026:10:20 09:15:00\0")])
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(blob) + 8) + b"Exif\0\0" + blob + b"\xff\xda\0\2\xff\xd9"
    got = generation.extract(jpeg)
    assert (got["claims"][0]["prompt"], got["claims"][0]["key"], got["claims"][0]["seed"]) == ("a 🦊 fox", "UserComment", "42")
    dates = [(c["created"], c["utc_offset"]) for c in got["claims"] if c["created"]]
    assert dates == [("2026:10:20 09:15:00", None)] and any(c["generator"] == "Some tool" for c in got["claims"])
    comment = b"UNICODE\0" + "b\nSteps: 1".encode("utf-16-le")
    blob = tiff("<", [(0x0131, 2, b"Tool nine\0")], [(0x9286, 7, comment), (0x9003, 2, b"2026:01:01 00:00:00\0"), (0x9011, 2, b"+05:30\0")])
    webp = lambda body: b"RIFF\0\0\0\0WEBPEXIF" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    got = generation.extract(webp(blob))
    assert (got["claims"][0]["container"], got["claims"][0]["prompt"]) == ("webp_exif", "b") and any(c["utc_offset"] == "+05:30" for c in got["claims"])
    assert generation.extract(webp(tiff("<", [], [(0x9286, 7, b"ASCII\0\0\0Holiday")])))["status"] == "none"
    packet = b'http://ns.adobe.com/xap/1.0/\0<!DOCTYPE x [<!ENTITY a "aa">]><r:D I:DigitalSourceType="http://cv/digitalsourcetype/trainedAlgorithmicMedia" xmp:CreatorTool="Firefly"/>'
    got = generation.extract(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(packet) + 2) + packet + b"\xff\xd9")
    assert [c["digital_source_type"] or c["generator"] for c in got["claims"]] == ["trainedAlgorithmicMedia", "Firefly"]


def test_listing_and_sound(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".hidden").mkdir()
    x = np.array([0.0, 1.0, -0.5, 0.25], np.float32)
    (tmp_path / "a" / "x.WAV").write_bytes(pcm.wav_bytes(x, 8000, 2))
    (tmp_path / "a" / "x.txt").write_text("no")
    (tmp_path / ".hidden" / "y.wav").write_bytes(b"")
    found = files.listing(spark, str(tmp_path), files.AUDIO, content=True)
    assert [r["path"].rsplit("/", 1)[1] for r in found.select("path").collect()] == ["x.WAV"]
    p = pcm.profiles(pcm.frames(found)).first()
    assert (p["channels"], p["frames"], p["peak"]) == (2, 2, 1.0)


def test_sound_formats_and_broken_files(spark):
    head = lambda form, bits, data: b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, form, 1, 8000, 8000 * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", len(data)) + data
    files_ = [("a", head(1, 24, b"\0\0\x40" + b"\0\0\xc0")), ("b", head(1, 16, struct.pack("<hh", 16384, -16384))), ("c", head(1, 8, b"\0\0")), ("d", b"no sound"), ("e", head(1, 16, b"\0")), ("f", None)]
    out = pcm.frames(spark.createDataFrame(files_, "path string, content binary")).collect()
    assert [(r["path"], r["frame"], r["value"]) for r in out if r["error"] is None] == [("a", 0, 0.5), ("a", 1, -0.5), ("b", 0, 0.5), ("b", 1, -0.5)]
    assert {r["path"] for r in out if r["error"]} == {"c", "d", "e", "f"}


def test_adoption_needs_one_record_and_a_gone_path(spark):
    cols = "id int, path string, volume int, file int, digest string"
    records = spark.createDataFrame([(1, "old", 1, 10, "d"), (2, "kept", 1, 11, "e"), (3, "c1", 1, 12, "f"), (4, "c2", 1, 12, "f")], cols)
    found = spark.createDataFrame([("new", 1, 10, "d"), ("kept", 1, 11, "e"), ("link", 1, 11, "e"), ("c3", 1, 12, "f")], "path string, volume int, file int, digest string")
    assert [tuple(r) for r in files.adopted(records, found).collect()] == [(1, "old", "new")]


def test_portable_round_trip(spark, tmp_path):
    rows = [("1", "s", "a b.wav", "T*", "ready", ["x"], None, True), ("2", "s", "é.wav", "U", "ready", [], "c", False)]
    df = spark.createDataFrame(rows, "id string, source_id string, relative_path string, title string, status string, user_tags array<string>, comment string, favorite boolean")
    portable.write_catalog(df, str(tmp_path / "c"))
    (tmp_path / "c" / "bad.txt").write_text('{"schema":"portable-catalog/1","sounds":[],"extra":1}\nnot json\n')
    back = portable.read_catalog(spark, str(tmp_path / "c"))
    assert sorted(r["problem"] for r in back.where("problem is not null").collect()) == ["not a catalogue", "unknown field"]
    assert {r["relative_path"] for r in back.where("problem is null").collect()} == {"a b.wav", "é.wav"}
    after = portable.imported(back, df.where("id = '1'"), {})
    assert sorted(r["id"] for r in after.collect()) == ["1", "2"]
    assert portable.markdown(df).where("id = '1'").first()["value"] is None or "T\\*" in portable.markdown(df.na.fill("")).where("id = '1'").first()["value"]


def test_admission(spark):
    df = spark.createDataFrame([("a/b.wav",), ("a/.b.wav",), ("a/~x",), ("x.tmp",)], "p string")
    assert [r["p"] for r in watch.admitted(df, "p").collect()] == ["a/b.wav"]
    assert df.select(F.lit(1)).count() == 4
