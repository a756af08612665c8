"""Signed feature hashing in plain Python, as an oracle for the encoder."""

import math
from hashlib import md5


def hashed(text, dim):
    sums = [0] * dim
    for word in text.lower().split():
        digits = md5(word.encode()).hexdigest()
        sums[int(digits[:8], 16) % dim] += -1 if int(digits[8], 16) % 2 else 1
    length = math.sqrt(sum(x * x for x in sums))
    return [x / length if length else 0.0 for x in sums]
