import random

import pytest

WORDS = "alpha bravo cargo delta ember fjord gamma harbor igloo jacket kernel ladder magnet nickel orbit pepper quartz ribbon saddle timber umbra velvet walnut xenon yellow zephyr".split()


@pytest.fixture
def texts():
    """Random texts of a small vocabulary, with edited copies."""
    rng = random.Random(3)
    made = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.randint(35, 80))) for _ in range(60)]
    for _ in range(60):
        w = made[rng.randrange(60)].split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        made.append(" ".join(w))
    return made
