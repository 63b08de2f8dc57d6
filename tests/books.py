"""Ebooks for the tests, zipped in memory."""

import io
import zipfile

CONTAINER = """<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>
<rootfile full-path="decoy.txt" media-type="text/plain"/><rootfile full-path="OPS/main.opf" media-type="application/oebps-package+xml"/></rootfiles></container>"""
OPF = """<?xml version="1.0" encoding="utf-8"?>
<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid" xml:lang="en" prefix="ex: http://example.org/ns# bad" dir="ltr">
<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:identifier id="uid">urn:x:1</dc:identifier>
<meta refines="#w1" property="role" scheme="marc:relators">aut</meta>
<dc:creator id="w1" opf:file-as="Attr, A">Ann &amp; Co</dc:creator>
<meta refines="w1" property="file-as">Co, Ann</meta>
<dc:creator id="w2" opf:role="ill">Ill</dc:creator>
<dc:title id="t1">Second
   title</dc:title><dc:title id="t2">Main</dc:title><meta refines="#t2" property="title-type">main</meta>
<dc:subject id="s1">late</dc:subject><dc:subject id="s2">early</dc:subject><meta refines="#s2" property="display-seq">1</meta>
<dc:language>en</dc:language><dc:date opf:event="publication">2020-3-7</dc:date><meta property="dcterms:modified">2021-05-06T07:08:09Z</meta>
<dc:description>one &unknown; <![CDATA[ two ]]>&#65;</dc:description>
<meta refines="#a1" property="media:duration">0:10:00</meta><meta name="cover" content="img"/>
</metadata>
<manifest>
<item id="c1" href="c1.xhtml" media-type="application/xhtml+xml" media-overlay="a1"/>
<item id="c2" href="sub/c%202.xhtml" media-type="application/xhtml+xml"/>
<item id="nav" href="../nav.xhtml" media-type="application/xhtml+xml" properties="scripted nav"/>
<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>
<item id="img" href="i.webp" media-type="image/webp" fallback="png"/>
<item id="png" href="i.png" media-type="image/png" fallback="img"/>
<item id="a1" href="a.smil" media-type="application/smil+xml"/>
</manifest>
<spine toc="ncx" page-progression-direction="rtl"><itemref idref="nav" linear="no"/><itemref idref="c1"/><itemref id="sp" idref="c2" linear="yes" properties="page-spread-left"/></spine>
<guide><reference type="text" title="Start" href="c1.xhtml"/></guide>
</package>"""
NAV = """<html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title></head><body>
<nav epub:type="toc" id="n"><h1>Contents</h1><ol><li id="l1"><a href="OPS/c1.xhtml#s">One</a><ol><li><a href="OPS/sub/c%202.xhtml?q=1#z">Two</a></li></ol></li><li><span>Group</span><ol><li><a href="gone.xhtml">Gone</a></li></ol></li></ol></nav>
<nav epub:type="landmarks"><ol><li><a epub:type="bodymatter" href="OPS/c1.xhtml">Body</a></li></ol></nav></body></html>"""
NCX = """<ncx><docTitle><text>Doc</text></docTitle><navMap><navPoint id="p1" playOrder="1"><navLabel><text>One</text></navLabel><content src="c1.xhtml"/>
<navPoint id="p2" playOrder="2"><navLabel><text>Two</text></navLabel><content src="sub/c%202.xhtml"/></navPoint></navPoint></navMap>
<pageList><pageTarget type="front" id="g1"><navLabel><text>i</text></navLabel><content src="c1.xhtml#i"/></pageTarget></pageList></ncx>"""
FILES = {
    "META-INF/container.xml": CONTAINER,
    "OPS/main.opf": OPF,
    "nav.xhtml": NAV,
    "OPS/toc.ncx": NCX,
    "OPS/c1.xhtml": '<html><head><title>1</title></head><body><a href="sub/c%202.xhtml">n</a><a href="#x">x</a><img src="i.png"/></body></html>',
    "OPS/sub/c 2.xhtml": "<html><head></head><body>two</body></html>",
    "OPS/i.png": b"\x89PNG",
    "extra.bin": b"orphan",
}


def book(**changes) -> bytes:
    """A zipped book; changes replace files by path (None: no such file)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        for name, data in (FILES | changes).items():
            if data is not None:
                z.writestr(name, data)
    return out.getvalue()
