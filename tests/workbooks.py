"""Writes small ``.xlsx`` packages for tests."""

from __future__ import annotations

import datetime as dt
import zipfile
from xml.sax.saxutils import escape

_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_STYLES = f"""<styleSheet {_MAIN}><numFmts count="2">
<numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/>
</numFmts><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/>
</cellXfs></styleSheet>"""


class Styled:
    """A number shown with one of the styles above."""

    def __init__(self, number, style):
        self.number, self.style = number, style


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(ref, value, shared):
    if value is None:
        return ""
    if isinstance(value, Styled):
        return f'<c r="{ref}" s="{value.style}"><v>{value.number}</v></c>'
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.datetime):
        days = (value - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
        return f'<c r="{ref}" s="1"><v>{days!r}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    if value.startswith("inline:"):
        return f'<c r="{ref}" t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
    if value == "#DIV/0!":
        return f'<c r="{ref}" t="e"><v>{value}</v></c>'
    shared.append(value)
    return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'


def write(path, sheets: dict[str, list[list]]) -> None:
    shared: list[str] = []
    with zipfile.ZipFile(path, "w") as out:
        names = list(sheets)
        entries = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)
        )
        out.writestr("xl/workbook.xml",
                     f'<workbook {_MAIN} xmlns:r="{_REL}"><sheets>{entries}</sheets></workbook>')
        rels = "".join(
            f'<Relationship Id="rId{i + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
            for i in range(len(names))
        )
        out.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>',
        )
        out.writestr("xl/styles.xml", _STYLES)
        for i, name in enumerate(names):
            body = ""
            for y, row in enumerate(sheets[name]):
                cells = "".join(_cell(f"{_letters(x)}{y + 1}", v, shared) for x, v in enumerate(row))
                body += f'<row r="{y + 1}">{cells}</row>'
            out.writestr(f"xl/worksheets/sheet{i + 1}.xml",
                         f"<worksheet {_MAIN}><sheetData>{body}</sheetData></worksheet>")
        # text in two runs must come back as one
        items = "".join(
            f'<si><r><t xml:space="preserve">{escape(s[:1])}</t></r><r><t xml:space="preserve">'
            f"{escape(s[1:])}</t></r></si>"
            for s in shared
        )
        out.writestr("xl/sharedStrings.xml", f"<sst {_MAIN}>{items}</sst>")
