"""PDF files for queries and tests, made of pages' boxes alone."""

from __future__ import annotations

import zlib


def file_of(objects: dict[int, str], packed: bool = False, root: int = 1) -> bytes:
    """A file of these objects; ``packed`` puts all of them in one compressed stream, with a stream for a table, else the table is plain."""
    if not packed:
        body, places = b"%PDF-1.4\n", {}
        for n, text in objects.items():
            places[n] = len(body)
            body += f"{n} 0 obj\n{text}\nendobj\n".encode("latin-1")
        table = "".join(f"{n} 1\n{places[n]:010d} 00000 n \n" for n in sorted(places))
        return body + f"xref\n0 1\n0000000000 65535 f \n{table}trailer\n<< /Size {max(objects) + 1} /Root {root} 0 R >>\nstartxref\n{len(body)}\n%%EOF".encode()
    texts = [t.encode("latin-1") for t in objects.values()]
    places = [sum(len(t) + 1 for t in texts[:i]) for i in range(len(texts))]
    head = " ".join(f"{n} {p}" for n, p in zip(objects, places, strict=True)).encode() + b" "
    data = zlib.compress(head + b"\n".join(texts))
    last = max(objects) + 1
    stream = f"{last} 0 obj\n<< /Type /ObjStm /N {len(texts)} /First {len(head)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    start = len(b"%PDF-1.5\n" + stream)
    return b"%PDF-1.5\n" + stream + f"{last + 1} 0 obj\n<< /Type /XRef /Size {last + 2} /Root {root} 0 R /W [1 2 1] /Length 0 >>\nstream\n\nendstream\nendobj\nstartxref\n{start}\n%%EOF".encode()


def made(key: int, pages: list[tuple[int, int]], packed: bool) -> bytes:
    """Pages in nodes of three each: those of kind 0 have a media box of their own, of 1 an inherited one that is turned, of 2 an inherited one, and of 3 a crop box that is turned."""
    nodes = [pages[i : i + 3] for i in range(0, len(pages), 3)]
    first = 10 + len(nodes)
    kinds = {0: "/MediaBox [0 0 {q} {r}]", 1: "/Rotate 90", 2: "", 3: "/CropBox [10 10 {x} {y}] /Rotate -90 /MediaBox [0 0 9 9]"}
    objects = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{10 + i} 0 R' for i in range(len(nodes)))}] /MediaBox 3 0 R >>", 3: "[0 0 500 700]"}
    for i, mine in enumerate(nodes):
        at = first + 3 * i
        objects[10 + i] = f"<< /Type /Pages /Parent 2 0 R /Kids [{' '.join(f'{at + j} 0 R' for j in range(len(mine)))}] /Count {len(mine)} >>"
        for j, (kind, q) in enumerate(mine):
            objects[at + j] = f"<< /Type /Page /Parent {10 + i} 0 R {kinds[kind].format(q=q, r=2 * q, x=q + 10, y=2 * q + 10)} >>"
    order = sorted(objects, key=lambda n: (n * 7919 + key) % 101)  # places in a file tell nothing of the order of pages
    return file_of({n: objects[n] for n in order}, packed)
