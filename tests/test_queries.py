"""Every registered query with SQL gives the rows that DuckDB gives."""

import compare
import pytest

from tidewatch.operators import windows
from tidewatch.plans import more, registry, states
from tidewatch.sources.shared import materialised

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.fixture(scope="module", autouse=True)
def composed_once(spark):
    """Many queries start from the packets' flows or states: the operators make both once, and these are read again."""
    flows = materialised(states.flows_of_packets(spark, SF), "flows")
    made = materialised(windows.build_states(flows), "states")
    with pytest.MonkeyPatch.context() as patch:
        for module in (states, more):
            patch.setattr(module, "flows_of_packets", lambda spark, sf_dir: flows)
            patch.setattr(module, "states_of_packets", lambda spark, sf_dir: made)
        yield


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    frame = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE:
        assert not compare.differences(frame, registry.ORACLE[name], con)
    else:
        assert len(frame)
