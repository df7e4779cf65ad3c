"""Both studies end to end from CSV files."""

from checks.views import Views
from tastemesh.plans.study import collaborative_study, content_study
from tastemesh.sources import csv

SF = "/root/testdata/sf0.001"


def test_studies_from_csv(spark, tmp_path):
    views = Views(spark, SF)
    paths = [str(tmp_path / n) for n in ("catalog", "ratings", "links")]
    csv.write_catalog(views.catalog(), paths[0])
    csv.write_csv(views.ratings(), paths[1])
    csv.write_csv(views.links(), paths[2])
    inputs = csv.load_inputs(spark, *paths)

    out = collaborative_study(inputs, [10])
    counts = out["counts"].first()
    assert out["summary"].first().users > 0
    assert out["pearson"].count() == out["cosine"].count() == 15
    assert out["consensus"].count() == counts.common <= min(counts.pearson, counts.cosine)
    assert out["consensus"].where("pearson_score <= 3.5").isEmpty()

    root = str(tmp_path / "vectors")
    content = content_study(inputs, [10], top_k=5, vector_root=root)
    assert content["recommendations"].count() == 5
    coverage = content["coverage"].first()
    assert 0 < coverage.matched <= coverage.total
    assert content["history"].count() == min(5, coverage.matched)
    again = content_study(inputs, [10], top_k=5, vector_root=root)
    assert again["vectors"].inputFiles() == content["vectors"].inputFiles()
