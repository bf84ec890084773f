"""3x3 colour matrices from published primaries and white points, worked out once on the driver."""

from __future__ import annotations

import numpy as np

# CIE xy chromaticities
D50 = (0.3457, 0.3585)
D65 = (0.3127, 0.3290)
ACES_WHITE = (0.32168, 0.33767)
AP1 = ((0.713, 0.293), (0.165, 0.830), (0.128, 0.044))
REC2020 = ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046))
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
XYZ_TO_SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))


def xyz(xy) -> np.ndarray:
    x, y = xy
    return np.array([x / y, 1.0, (1.0 - x - y) / y])


def rgb_to_xyz(primaries, white) -> np.ndarray:
    columns = np.stack([xyz(p) for p in primaries], axis=1)
    return columns * np.linalg.solve(columns, xyz(white))


def adaptation(source, target) -> np.ndarray:
    """Bradford adaptation between two white points."""
    cone = np.array(BRADFORD)
    gain = (cone @ xyz(target)) / (cone @ xyz(source))
    return np.linalg.inv(cone) @ np.diag(gain) @ cone


def pcs_to_working() -> np.ndarray:
    """XYZ under D50 -> the AP1 working space."""
    return np.linalg.inv(rgb_to_xyz(AP1, ACES_WHITE)) @ adaptation(D50, ACES_WHITE)


def source_to_working(rgb_to_pcs) -> np.ndarray:
    return pcs_to_working() @ np.asarray(rgb_to_pcs, dtype=float)


def rec2020_to_pcs() -> np.ndarray:
    return adaptation(D65, D50) @ rgb_to_xyz(REC2020, D65)


def working_to_srgb() -> np.ndarray:
    return np.array(XYZ_TO_SRGB) @ adaptation(ACES_WHITE, D65) @ rgb_to_xyz(AP1, ACES_WHITE)
