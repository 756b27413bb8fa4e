import pytest

from shiftgrid.functions.scalar import next_fft_size
from shiftgrid.params import Gardner, Preprocess, params

BAD = [
    (dict(similarity="ssd"), "similarity"), (dict(similarity=()), "similarity"), (dict(preprocess="blur"), "preprocess"), (dict(quantize="int8"), "quantize"),
    (dict(subpixel="spline"), "subpixel"), (dict(filter_width=4), "filter_width"), (dict(filter_width=1), "filter_width"), (dict(upsampling=48), "upsampling"),
    (dict(upsampling=1), "upsampling"), (dict(chip_size=30), "chip_size"), (dict(chip_size=0), "chip_size"), (dict(chip_size_min=16), "chip_size"),
    (dict(chip_size_min=256), "chip_size_min"), (dict(chip_size_max=96), "chip_size_max"), (dict(chip_aspect=0), "chip_aspect"), (dict(grid_spacing=0), "grid_spacing"),
    (dict(search_radius=0), "search_radius"), (dict(search_radius=-1), "search_radius"), (dict(search_radius=2.5), "search_radius"), (dict(coarse_stride=0), "coarse_stride"),
    (dict(min_coarse_valid_fraction=1.5), "min_coarse_valid_fraction"), (dict(outliers="median"), "outliers"), (dict(outlier_window=4), "outlier_window"),
    (dict(outlier_iterations=0), "outlier_iterations"), (dict(min_agree_fraction=2), "min_agree_fraction"), (dict(agree_tolerance=0), "agree_tolerance"),
    (dict(mad_scale=0), "mad_scale"), (dict(fill_window=2), "fill_window"), (dict(outliers="none", mad_scale=3), "mad_scale"),
    (dict(outliers=Gardner(), outlier_window=7), "window"), (dict(preprocess=Preprocess("wallis"), filter_width=7), "filter_width"), (dict(rotation=()), "rotation"),
]


@pytest.mark.parametrize("keywords, name", BAD)
def test_errors_name_the_keyword(keywords, name):
    with pytest.raises(ValueError, match=name):
        params(**keywords)


def test_defaults_and_levels():
    p = params()
    assert p.chip_sizes() == (32, 64, 128) and p.grid_spacing == 32 and p.measures() == ("zncc",) * 3
    assert params(similarity=("coherence", "zncc")).measures() == ("coherence", "zncc", "zncc")
    with pytest.raises(ValueError, match="similarity"):
        params(similarity=("zncc",) * 4).measures()
    assert params(chip_size_min=96, chip_size_max=128).chip_sizes() == (128,)
    assert params(search_radius=(5, 0)).radius_y == 0 and params(chip_aspect=0.75).chip_height(32) == 24
    assert Gardner(iterations=1).relaxed().iterations == 1 and params(rotation=True).rotation.tried()[0] == -6.0
    assert params(subpixel="none").upsampling == 1


def test_fft_sizes():
    assert [next_fft_size(n) for n in (1, 2, 16)] == [1, 2, 16]
    for n in range(2, 400):
        m = next_fft_size(n)
        assert n <= m <= 1.5 * n + 1
