"""Array archives and checkpoint archives that tests write themselves."""

import hashlib
import io
import json
import struct
import tarfile

import numpy as np
import pytest

from auditframe.sources import archives


def safetensors(path, arrays, broken=False):
    at, header, data = 0, {"__metadata__": {"model": "m"}}, b""
    for name, a in arrays.items():
        raw = a.astype("<f4").tobytes()
        header[name] = {"dtype": "F32", "shape": list(a.shape), "data_offsets": [at, at + len(raw)]}
        at, data = at + len(raw), data + raw
    head = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + (data[: len(data) // 2] if broken else data))


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(1)
    made = {
        "p1": {"single_embeddings": rng.normal(size=(7, 384)).astype("f4"), "pair_embeddings": rng.normal(size=(7, 7, 128)).astype("f4")},
        "p2": {"single_embeddings": rng.normal(size=(5, 384)), "metadata": np.array(json.dumps({"model": "x", "ü": 1}))},
        "p3": {"pair_embeddings": np.asfortranarray(rng.normal(size=(4, 5, 128)))}, "p4": {"other": np.arange(6)}, "p6": {"things": np.array([{}], dtype=object)},
    }
    for name, arrays in made.items():
        (np.savez if name != "p2" else np.savez_compressed)(tmp_path / f"{name}.npz", **arrays)
    (tmp_path / "p5.npz").write_bytes(b"PK not a zip")
    (tmp_path / "deep").mkdir()
    safetensors(tmp_path / "deep" / "s1.safetensors", {"single": np.ones((3, 2)), "big": np.zeros((400, 400))})
    safetensors(tmp_path / "s2.safetensors", {"single": np.ones((3, 2))}, broken=True)
    (tmp_path / "note.txt").write_text("not an archive")
    return tmp_path, made


def test_headers_come_without_payloads(spark, folder):
    path, made = folder
    df = archives.read_arrays(spark, str(path))
    assert df.rdd.getNumPartitions() == 8 and "values" not in df.columns
    rows = {(r.path.rsplit("/", 1)[-1], r.member): r for r in df.collect()}
    for name, arrays in made.items():
        for member, a in arrays.items():
            r = rows[f"{name}.npz", member]
            if name != "p6":
                assert r.shape == list(a.shape) and r.error is None and (r.dtype == a.dtype.name or member == "metadata")
    assert json.loads(rows["p2.npz", "metadata"].text) == {"model": "x", "ü": 1}
    size = (path / "p1.npz").stat().st_size
    assert rows["p1.npz", "pair_embeddings"].bytes_read < 20_000 < size
    assert rows["s1.safetensors", "big"].bytes_read < 1000 and rows["s1.safetensors", "big"].shape == [400, 400]
    assert "BadZipFile" in rows["p5.npz", None].error and rows["s2.safetensors", "single"].error == "size" and rows["p6.npz", "things"].error == "objects are not read"
    assert archives.read_arrays(spark, f"file://{path}/p4.npz").first().shape == [6]
    with pytest.raises(Exception, match="no such path"):
        archives.read_arrays(spark, f"{path}/none").collect()


def test_tensors_if_asked(spark, folder):
    path, made = folder
    rows = {(r.path.rsplit("/", 1)[-1], r.member): r for r in archives.read_arrays(spark, str(path), tensors=True).where("error IS NULL").collect()}
    for name in ("p1", "p2", "p3", "p4"):
        for member, a in made[name].items():
            if a.dtype.kind in "fi":
                assert np.array_equal(np.array(rows[f"{name}.npz", member]["values"]).reshape(a.shape), a)
    assert rows["s1.safetensors", "single"]["values"] == [1.0] * 6


def test_model_outputs_have_their_shapes(spark, folder):
    path, _ = folder
    catalog = spark.createDataFrame([("p1", 7), ("p2", 5), ("p3", 4), ("p4", 6), ("p5", 3), ("p7", 2)], "protein_id string, n int")
    found = {r.protein_id: (r.has_single, r.has_pair, r.why and r.why.split(":")[0]) for r in archives.model_outputs(archives.read_arrays(spark, str(path)), catalog, "protein_id", "n").collect()}
    assert found == {"p1": (True, True, None), "p2": (True, False, None), "p3": (False, True, "shape of pair"), "p4": (False, False, "no embeddings"), "p5": (False, False, "broken"), "p7": (False, False, "no file")}
    longer = catalog.withColumn("n", catalog.n + 1)
    assert {r.protein_id: r.why for r in archives.model_outputs(archives.read_arrays(spark, str(path)), longer, "protein_id", "n").collect()}["p1"] == "shape of single"


def packed(tmp_path, name, entries, width=4, **changes):
    """An archive of {digest: array} and its sidecar; ``changes`` replace parts of the sidecar."""
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as bundle:
        for digest, a in entries.items():
            raw = io.BytesIO()
            np.savez(raw, single=a, metadata=np.array("{}"))
            info = tarfile.TarInfo(f"embeddings/{digest}.npz")
            info.size = len(raw.getvalue())
            bundle.addfile(info, io.BytesIO(raw.getvalue()))
        note = tarfile.TarInfo("readme.txt")
        bundle.addfile(note, io.BytesIO(b""))
    content = data.getvalue()
    (tmp_path / f"{name}.tar.gz").write_bytes(content)
    told = {"archive_sha256": hashlib.sha256(content).hexdigest(), "size": len(content), "embedding_width": width, "sequence_sha256": list(entries)} | changes
    (tmp_path / f"{name}.json").write_text(json.dumps(told))
    return content


def test_checkpoints_come_in_whole_or_not_at_all(spark, tmp_path):
    seqs = ["ACD", "KLMN", "PQ", "WY"]
    digest = [hashlib.sha256(s.encode()).hexdigest() for s in seqs]
    catalog = spark.createDataFrame([(f"p{i}", s, d, len(s)) for i, (s, d) in enumerate(zip(seqs, digest, strict=True))], "protein_id string, sequence string, sequence_sha256 string, sequence_length int")
    arrays = {d: np.arange(len(s) * 4, dtype="f4").reshape(-1, 4) for s, d in zip(seqs, digest, strict=True)}
    good, target = tmp_path / "good", str(tmp_path / "table.parquet")
    good.mkdir()
    packed(good, "embedding_0", {d: arrays[d] for d in digest[:2]})
    packed(good, "embedding_1", {d: arrays[d] for d in digest[2:]})
    assert archives.import_checkpoints(spark, str(good), catalog, target, 4) == 4
    for r in spark.read.parquet(target).collect():
        assert np.array_equal(np.frombuffer(r.data, "<f4").reshape(r["shape"]), arrays[r.sequence_sha256]) and r.protein_id == f"p{digest.index(r.sequence_sha256)}"

    bad = arrays[digest[0]].copy()
    bad[0, 0] = np.nan
    other = "0" * 64
    cases = {
        "broken off": lambda p: (p / "embedding_0.tar.gz").write_bytes(packed(p, "embedding_0", {digest[0]: arrays[digest[0]]})[:-200]), "listed twice": lambda p: [packed(p, f"embedding_{k}", {digest[0]: arrays[digest[0]]}) for k in (0, 1)],
        "digest or size": lambda p: packed(p, "embedding_0", {digest[0]: arrays[digest[0]]}, archive_sha256="0"), "listed, not held": lambda p: packed(p, "embedding_0", {digest[0]: arrays[digest[0]]}, sequence_sha256=digest[:2]),
        "held, not listed": lambda p: packed(p, "embedding_0", {d: arrays[d] for d in digest[:2]}, sequence_sha256=digest[:1]), "not in the catalog": lambda p: packed(p, "embedding_0", {other: arrays[digest[0]]}),
        "shape": lambda p: packed(p, "embedding_0", {digest[0]: arrays[digest[1]]}), "not finite": lambda p: packed(p, "embedding_0", {digest[0]: bad}), "width": lambda p: packed(p, "embedding_0", {digest[0]: arrays[digest[0]]}, embedding_width=8),
        "no usable sidecar": lambda p: (packed(p, "embedding_0", {digest[0]: arrays[digest[0]]}), (p / "embedding_0.json").write_text("{")), "no archive": lambda p: (packed(p, "embedding_0", {digest[0]: arrays[digest[0]]}), (p / "embedding_0.tar.gz").rename(p / "x.tar.gz")),
        "list": lambda p: packed(p, "embedding_0", {digest[0]: arrays[digest[0]]}, sequence_sha256=[digest[0]] * 2),
    }
    for i, (why, make) in enumerate(cases.items()):
        folder = tmp_path / f"bad{i}"
        folder.mkdir()
        make(folder)
        with pytest.raises(ValueError, match=why):
            archives.import_checkpoints(spark, str(folder), catalog, target, 4)
        assert spark.read.parquet(target).count() == 4  # the table stays as it was
