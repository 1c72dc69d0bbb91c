import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lamina.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), "lamina-tests")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


@pytest.fixture(scope="session")
def to_pixels(spark):
    import numpy as np
    import pandas as pd

    def convert(grids, name="cls"):
        frames = []
        for section, grid in grids.items():
            yy, xx = np.mgrid[:grid.shape[0], :grid.shape[1]]
            frames.append(pd.DataFrame({"section_id": section, "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"),
                                        name: grid.ravel()}))
        return spark.createDataFrame(pd.concat(frames))

    return convert
