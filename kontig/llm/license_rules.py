"""Known licence sentences and ordered licence rules."""

from __future__ import annotations

#: Identifiers of known licence sentences and the sentences, before normalisation.
SENTENCES = (
    ("apache2-grant", "Licensed under the Apache License, Version 2.0"),
    ("apache2-grant", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache2-comply", "you may not use this file except in compliance with the License"),
    ("apache2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-asis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit-release", "Released under the MIT License"),
    ("mit-title", "MIT License"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("gpl3-license", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-nowarranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("cc-by-nc-4", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4", "Licensed under CC BY-SA 4.0"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("spdx-mit", "SPDX-License-Identifier: MIT"),
    ("spdx-apache2", "SPDX-License-Identifier: Apache-2.0"),
    ("spdx-gpl3", "SPDX-License-Identifier: GPL-3.0-only"),
    ("spdx-mpl2", "SPDX-License-Identifier: MPL-2.0"),
    ("spdx-bsd3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl2-grant", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("lgpl3-redistribute", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl3-redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsl-grant", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)

#: Licence, and the sentence identifiers that must follow each other, more specific rules first.
RULES = (
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-copy", "apache2-asis")),
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-copy")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-nowarranty")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("Apache-2.0", ("apache2-grant",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("MIT", ("mit-release",)),
    ("MIT", ("spdx-mit",)),
    ("GPL-3.0", ("gpl3-license",)),
    ("GPL-3.0", ("spdx-gpl3",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute",)),
    ("AGPL-3.0-or-later", ("agpl3-redistribute",)),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("MPL-2.0", ("mpl2-grant",)),
    ("MPL-2.0", ("spdx-mpl2",)),
    ("BSD-3-Clause", ("spdx-bsd3",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("MIT", ("mit-title",)),
)
