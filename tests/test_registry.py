"""Operators by name."""

import json

import pytest

from latticeweave.errors import ConfigurationError, UnsupportedPeriodicityError
from latticeweave.operators.tensors import valle_oganov
from latticeweave.registry import create_descriptor, describe_descriptor, from_configuration, list_descriptors
from latticeweave.sources.structures import from_frames

MODEL = "nep4 1 H\ncutoff 4 3 9 9\nn_max 0 0\nbasis_size 0 0\nl_max 1 0 0\nANN 1 0\n" + "0.5\n" * 9


def test_round_trip_through_json():
    for name in list_descriptors():
        required = {k: MODEL if k == "model" else (1, 8) for k, v in describe_descriptor(name)["parameters"].items() if v["required"]}
        made = create_descriptor(name, **required)
        assert from_configuration(json.loads(json.dumps(made.configuration()))) == made


def test_metadata():
    assert len(list_descriptors(detailed=True)) == len(list_descriptors()) > 10
    assert describe_descriptor("MBTR")["periodic_only"] and not describe_descriptor("ACSF")["periodic_only"]


def test_errors_name_the_place():
    for name, parameters, path in (("None", {}, "descriptor"), ("ACSF", {}, "parameters.species"), ("SO3", {"x": 1}, "parameters.x"), ("SO3", {"nmax": 0}, "nmax")):
        with pytest.raises(ConfigurationError) as error:
            create_descriptor(name, **parameters)
        assert error.value.path == path


@pytest.mark.parametrize("function", ["distance", "angle"])
def test_fingerprint_by_name_equals_its_preset(spark, function):
    frames = [{"numbers": [1, 8, 1], "positions": [[0, 0, 0], [1, 0, 0], [0, 1.5, 0]], "cell": [[4, 0, 0], [0, 4, 0], [0, 0, 4]], "pbc": True}]
    made = create_descriptor("ValleOganov", species=(1, 8), function=function, n=7, sigma=0.5, r_cut=3.0)
    got, want = ([r.features for r in operator.compute(*from_frames(spark, frames)).collect()] for operator in (made, valle_oganov((1, 8), function, 7, 0.5, 3.0)))
    assert got == [pytest.approx(want[0])] and any(got[0]) and len(got[0]) == made.width
    with pytest.raises(UnsupportedPeriodicityError):
        made.compute(*from_frames(spark, [{"numbers": [1], "positions": [[0, 0, 0]]}]))
    with pytest.raises(ConfigurationError):
        create_descriptor("ValleOganov", species=(1, 8), function="x")
