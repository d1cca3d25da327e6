"""The logistic curve is fitted where whole Newton steps run away from the least loss."""

import numpy as np

from corpuslake.llm import compression


def test_fit_of_classes_that_are_nearly_apart():
    counts = {0: {0: 292, 1: 8}, 1: {0: 4, 1: 21, 2: 46, 3: 62, 4: 60, 5: 41, 6: 27, 7: 14, 8: 17, 9: 7, 12: 1}}
    x = np.concatenate([np.repeat(list(c), list(c.values())) for c in counts.values()]).astype(float)[:, None]
    y = np.repeat([0.0, 1.0], [sum(c.values()) for c in counts.values()])
    model = compression.Model(compression.TOXICITY, prior=0.3)
    compression._fit(model, x, y)
    assert ((compression.probability(model, x) >= 0.5) == y).mean() > 0.95
