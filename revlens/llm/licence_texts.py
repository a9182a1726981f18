"""Sentences of well-known licences, and the order in which
their identifiers make a licence.  The sentences are those of the published
licence texts and notices."""

SENTENCES = {
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MitAsIs": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MitLiability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MitRef": "Released under the MIT License.",
    "MitRefLicensed": "Licensed under the MIT License.",
    "BsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BsdEndorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BsdAsIs": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ApacheHead": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "ApacheComply": "you may not use this file except in compliance with the License.",
    "ApacheCopy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ApacheAsIs": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License.",
    "ApacheRef": "Licensed under the Apache License, Version 2.0.",
    "Gpl2OrLater": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Gpl3OrLater": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GplNoWarranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GplSee": "See the GNU General Public License for more details.",
    "Gpl3Ref": "This work is licensed under the GNU General Public License, version 3.",
    "Gpl2Ref": "This work is licensed under the GNU General Public License, version 2.",
    "MplNotice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MplCopy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain; no licence is needed.",
    "CcByNc4Ref": "Licensed under CC BY-NC 4.0.",
    "CcBy4Ref": "Licensed under CC BY 4.0.",
    "CcBySa4Ref": "Licensed under CC BY-SA 4.0.",
    "CcByNd4Ref": "Licensed under CC BY-ND 4.0.",
    "CcByNcSa4Ref": "Licensed under CC BY-NC-SA 4.0.",
    "CcByNcNd4Ref": "Licensed under CC BY-NC-ND 4.0.",
    "CcBy4Work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Cc0Ref": "Licensed under CC0 1.0.",
    "Gpl2Terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Gpl3Terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Gpl2OnlyTerms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "Lgpl21Terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Lgpl3Terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Agpl3Terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LibraryNoWarranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LgplSee": "See the GNU Lesser General Public License for more details.",
    "AgplSee": "See the GNU Affero General Public License for more details.",
    "Epl2Notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BoostNotice": "Distributed under the Boost Software License, Version 1.0.",
    "BoostSee": "(See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "BoostSeeHttp": "(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
}

#: Sentences with a name in the middle: identifier, words before it, words after it.
SLOTS = (
    ("BsdEndorse", "Neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BsdEndorse", "Neither the name of", "nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BsdEndorse", "The name of", "may not be used to endorse or promote products derived from this software without specific prior written permission."),
)

#: Tried in this order at each place; the first that fits takes its sentences.
#: A sentence in brackets may be absent.
RULES = (
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "[MitLiability]")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "[BsdAsIs]")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "[BsdAsIs]")),
    ("ISC", ("IscGrant",)),
    ("Apache-2.0", ("ApacheHead", "ApacheComply", "[ApacheCopy]", "[ApacheAsIs]", "[ApacheSee]")),
    ("GPL-2.0-or-later", ("Gpl2OrLater", "[GplNoWarranty]", "[GplSee]")),
    ("GPL-3.0-or-later", ("Gpl3OrLater", "[GplNoWarranty]", "[GplSee]")),
    ("GPL-2.0-or-later", ("Gpl2Terms", "[GplNoWarranty]", "[GplSee]")),
    ("GPL-3.0-or-later", ("Gpl3Terms", "[GplNoWarranty]", "[GplSee]")),
    ("GPL-2.0-only", ("Gpl2OnlyTerms", "[GplNoWarranty]", "[GplSee]")),
    ("LGPL-2.1-or-later", ("Lgpl21Terms", "[LibraryNoWarranty]", "[GplNoWarranty]", "[LgplSee]")),
    ("LGPL-3.0-or-later", ("Lgpl3Terms", "[LibraryNoWarranty]", "[GplNoWarranty]", "[LgplSee]")),
    ("AGPL-3.0-or-later", ("Agpl3Terms", "[GplNoWarranty]", "[AgplSee]")),
    ("EPL-2.0", ("Epl2Notice",)),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("BoostNotice", "[BoostSee]", "[BoostSeeHttp]")),
    ("MPL-2.0", ("MplNotice", "[MplCopy]")),
    ("Unlicense", ("Unlicense",)),
    ("MIT", ("MitRef",)),
    ("MIT", ("MitRefLicensed",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("CC-BY-NC-4.0", ("CcByNc4Ref",)),
    ("CC-BY-SA-4.0", ("CcBySa4Ref",)),
    ("CC-BY-ND-4.0", ("CcByNd4Ref",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSa4Ref",)),
    ("CC-BY-NC-ND-4.0", ("CcByNcNd4Ref",)),
    ("CC-BY-4.0", ("CcBy4Ref",)),
    ("CC-BY-4.0", ("CcBy4Work",)),
    ("CC0-1.0", ("Cc0Ref",)),
)

#: The tag line that names a licence of these rules by its identifier.
SPDX_TAG = "SPDX-License-Identifier: {0}"
_named = sorted({licence for licence, _ in RULES})
SENTENCES |= {f"Spdx:{licence}": SPDX_TAG.format(licence) for licence in _named}
RULES += tuple((licence, (f"Spdx:{licence}",)) for licence in _named)
