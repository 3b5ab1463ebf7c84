"""PowerPoint files and the mark of a cut sheet, from files that the test writes itself."""

import zipfile

from dossier.sources import files

A, P, R = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def sp(*paragraphs):
    body = "".join(f"<a:p>{p}</a:p>" for p in paragraphs)
    return f"<p:sp><p:txBody>{body}</p:txBody></p:sp>"


def run(text):
    return f"<a:r><a:t>{text}</a:t></a:r>"


def test_presentations(spark, tmp_path):
    cell = lambda t: f"<a:tc><a:txBody><a:p>{run(t)}</a:p></a:txBody></a:tc>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell('x')}{cell('y')}</a:tr><a:tr>{cell('1')}{cell('')}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    group = f"<p:grpSp>{sp(run('in group'))}<p:grpSp><p:pic/>{sp(run('deep'))}</p:grpSp></p:grpSp>"
    slides = [sp(run("Title"), run("two") + "<a:br/>" + run("lines")) + sp(" ") + group, table + "<p:pic/>"]
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        ids = "".join(f'<p:sldId r:id="r{k}"/>' for k in (1, 0))  # the second file is the first slide
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", "<R>" + "".join(f'<X Id="r{k}" Target="slides/s{k}.xml"/>' for k in (0, 1)) + "</R>")
        for k, body in enumerate(slides):
            z.writestr(f"ppt/slides/s{k}.xml", f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>')
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    got = {(r.path.rsplit("/", 1)[1], r.part, r.part_no, r.row_no, tuple(r.cells or ()), r.error) for r in files.office_rows(files.listing(spark, f"file://{tmp_path}")).collect()}
    assert got == {
        ("a.pptx", "table", 0, 0, ("x", "y"), None), ("a.pptx", "table", 0, 1, ("1", ""), None), ("a.pptx", "picture", 0, 1, (), None), ("a.pptx", "shape", 1, 0, ("Title\ntwo\vlines",), None),
        ("a.pptx", "shape", 1, 2, ("in group",), None), ("a.pptx", "picture", 1, 3, (), None), ("a.pptx", "shape", 1, 4, ("deep",), None), ("bad.pptx", None, None, None, (), "BadZipFile"),
    }


def test_cut_sheets_say_so(monkeypatch):
    monkeypatch.setattr(files, "SHEET_ROWS", 2)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    import io

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/_rels/workbook.xml.rels", '<R><X Id="r1" Target="s.xml"/></R>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{R}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/s.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row><c r="A{k}"><v>{k}</v></c></row>' for k in (1, 2, 3, 4)) + "</sheetData></worksheet>")
    assert list(files._excel(data.getvalue())) == [("S", 0, 0, ["1"]), ("S", 0, 1, ["2"]), ("cut", 0, 2, ["S"])]
