"""A small assembly with planted errors: a reference, queries cut from it, and how an aligner reports them."""

import hashlib
import random

R = "".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(625)).translate(str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT"))
INSERTED = "TTGACCGATTACAGGCTTAG"


def turned(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


QUERIES = {
    1: R[:5000],
    2: R[5000:9000] + R[15000:19000],
    3: R[9000:10500] + INSERTED + R[10500:12000],
    4: turned(R[12000:14000]),
    5: "".join(random.Random(5).choices("ACGT", k=3000)),
}
#: (key, subject, strand, q_start, q_end, s_start, s_end, gap_num) as an aligner reports them.
SEGMENTS = [(1, 1, 0, 1, 5000, 1, 5000, 0), (2, 1, 0, 1, 4000, 5001, 9000, 0), (2, 1, 0, 4001, 8000, 15001, 19000, 0), (3, 1, 0, 1, 3020, 9001, 12000, 20), (4, 1, 1, 1, 2000, 14000, 12001, 0)]
