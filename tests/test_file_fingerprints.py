import hashlib
from urllib.parse import unquote

from gridsight.operators import catalog


def test_fingerprints_of_large_files(spark, tmp_path, monkeypatch):
    for name, size in (("a b.bin", 3), ("piece.bin", catalog.WHOLE), ("over.bin", catalog.WHOLE + 1), ("large.bin", (1 << 31) + 5), ("x.txt", 1)):
        with (tmp_path / name).open("wb") as file:
            file.write(name.encode()[:size])
            file.truncate(size)
    want = {}
    for path in tmp_path.glob("*.bin"):
        with path.open("rb") as file:
            want[path.name] = (path.stat().st_size, hashlib.file_digest(file, "sha256").hexdigest())
    shown = lambda: {unquote(r["path"]).rpartition("/")[2]: (r["byte_size"], r["fingerprint"]) for r in
                     catalog.file_fingerprints(spark, str(tmp_path), "*.bin").collect()}
    assert shown() == want and len(want) == 4

    def closed(path):
        raise OSError(path)
    monkeypatch.setattr(catalog, "_opened", closed)
    assert shown() == want
