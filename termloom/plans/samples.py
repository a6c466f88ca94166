"""A small lexicon in the lexicon file format, for queries and tests. Written for this project."""

from __future__ import annotations

DATA = {
    "noun": [
        "00000001 03 n 02 ferry 0 ferryboat 0 002 @ 00000002 n 0000 ~ 00000003 n 0000 | a boat that carries people across",
        "00000002 03 n 0a boat 0 vessel 0 craft 0 watercraft 0 hull 0 bottom 0 ship 0 barge 0 lighter 0 tub 0 001 ~ 00000001 n 0000 | floats",
        "00000003 03 n 01 chain_ferry 0 003 @ 00000001 n 0000 @i 00000002 n 0000 ! 00000002 n 0101 | pulled along a chain",
        "00000004 03 n 01 lighthouse 0 000 | a tower with a light",
        "00000005 03 n 02 box 0 Box 0 000 | a container",
    ],
    "verb": ["00000011 35 v 02 ferry 0 transport 0 001 @ 00000012 v 0000 | carry across", "00000012 35 v 01 carry 0 001 ~ 00000011 v 0000 | move"],
    "adj": ["00000021 00 a 01 old 0 000 | not new"],
    "adv": ["00000031 02 r 01 slowly 0 000 | not fast"],
}
INDEX = {
    "noun": ["ferry n 1 2 @ ~ 1 1 00000001", "boat n 1 1 ~ 1 0 00000002", "lighthouse n 1 0 1 0 00000004", "box n 1 0 1 0 00000005", "notice n 1 0 1 0 00000004"],
    "verb": ["ferry v 1 1 @ 1 0 00000011", "carry v 1 1 ~ 1 0 00000012", "sell v 1 0 1 0 00000012", "measure v 1 0 1 0 00000012"],
    "adj": ["old a 1 0 1 0 00000021", "deep a 1 0 1 0 00000021"],
    "adv": ["slowly r 1 0 1 0 00000031"],
}
EXCEPTIONS = {"noun": ["mice mouse"], "verb": ["sold sell", "found find"], "adj": ["better good well"], "adv": ["better well"]}
