"""Licence texts and the usual notices of several lines, by SPDX identifier."""

from __future__ import annotations

from importlib.resources import files

_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
    "You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
)
_CC = "This work is licensed under a Creative Commons {0} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/{1}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."


def _texts() -> list[tuple[str, str]]:
    out = [(p.name.removesuffix(".txt"), p.read_text()) for p in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")]
    gpl = dict(out)["GPL-3.0"]
    # The Affero licence is the general one under its own name; its section 13 apart.
    affero = gpl.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General Public", "GNU Affero General Public").replace("29 June", "19 November")
    return [*out, ("AGPL-3.0", affero)]


#: Full texts of licences.
TEXTS: tuple[tuple[str, str], ...] = tuple(_texts())
#: Headers of source files, and what stands in place of a full text.
HEADERS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", dict(TEXTS)["Apache-2.0"].split("[name of copyright owner]")[-1]),
    *((f"{short}-{v}", _GNU.format(what=what, name=name, v=v.removesuffix(".0"))) for short, name, v in (("GPL", "General Public License", "2.0"), ("GPL", "General Public License", "3.0"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3.0"), ("AGPL", "Affero General Public License", "3.0")) for what in ("program", "library")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", _CC.format("Attribution", "by")),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike", "by-sa")),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial", "by-nc")),
)
NOTICES = TEXTS + HEADERS
#: What may follow SPDX-License-Identifier, in lower case.
SPDX: dict[str, str] = {f"{n.lower()}{end}": n for n, _ in NOTICES for end in ("", *(("-only", "-or-later", "+") if "GPL" in n else ()))}
