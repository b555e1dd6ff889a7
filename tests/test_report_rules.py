"""Hand-made rows for the rules that differ silently between engines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from crewlytics.functions import fixed_values as fv
from crewlytics.operators.distribution import PEOPLE, Dim, distribution
from crewlytics.operators.filters import staff
from crewlytics.operators.ordering import first_by, ranked
from crewlytics.plans import (
    age,
    blood,
    datasets,
    education,
    employees,
    engagement,
    family,
    interns,
    location,
    movements,
)

STAFF = {"org_ref": "1", "is_active": 1, "is_regular": 1}


def people(*rows):
    return {"personnel": [STAFF | {"emp_id": i} | row for i, row in enumerate(rows)]}


def table(df):
    return [tuple(row) for row in df.collect()]


def test_label_after_grouping_keeps_two_groups(given):
    w = given(**people({"staff_group": None}, {"staff_group": "Diğer"}, {"staff_group": "Mavi Yaka"}))
    assert sorted(table(employees.employees_dist_collar(w))) == [
        ("Diğer", 1),
        ("Diğer", 1),
        ("Mavi Yaka", 1),
    ]


def test_label_in_the_key_merges_them(given):
    w = given(**people({"duty_place": None}, {"duty_place": fv.NO_DUTY_PLACE}))
    assert table(employees.employees_duty_place(w)) == [(fv.NO_DUTY_PLACE, 2)]


def test_sums_over_no_rows_are_null_and_counts_are_zero(given):
    assert table(interns.intern_kpi_summary(given())) == [(None, None, 0)]
    assert table(family.family_kpi_summary(given())) == [(0, None, None)]
    assert table(engagement.engagement_kpi_summary(given())) == [(0.0, 0.0)]


def test_ratio_without_active_staff_is_null(given):
    w = given(**people({"is_active": 0, "is_leaver": 1, "gender": "KADIN", "age": 30}))
    row = employees.employees_kpi_summary(w).first()
    assert (row.total_active, row.leavers, row.female_ratio, row.avg_age) == (0, 1, None, None)


def test_null_comes_first_in_descending_order(given):
    rows = [{"org_ref": "1", "work_duration": d} for d in (5, None, 1)]
    found = engagement.engagement_details(given(engagement=rows))
    assert [r.work_duration for r in found.collect()][0] is None


def test_null_comes_last_in_ascending_order(given):
    w = given(**people({"company": None, "full_name": "a"}, {"company": "Z", "full_name": "b"}))
    assert [r.company for r in location.location_employee_list(w).collect()] == ["Z", None]


def test_unknown_city_gets_the_bare_prefix(given):
    w = given(**people({"residence_city": None}, {"residence_city": "KONYA"}, {"residence_city": "İZMİR"}))
    assert sorted(table(location.location_map_residence(w)), key=str) == sorted(
        [("TR-", None, 1), ("TR-KO", "KONYA", 1), ("TR-35", "İZMİR", 1)], key=str
    )


def test_duty_city_falls_back_to_itself(given):
    w = given(**people({"duty_city": None}, {"duty_city": "BURSA"}, {"duty_city": "ANKARA"}))
    assert sorted(table(location.location_map_duty(w)), key=str) == sorted(
        [(None, None, 1), ("BURSA", "BURSA", 1), ("TR-06", "ANKARA", 1)], key=str
    )


def test_group_without_any_id_is_dropped_from_the_map(given):
    rows = [STAFF | {"duty_city": "ADANA"}, STAFF | {"duty_city": "BURSA", "emp_id": 1}]
    assert table(location.location_map_duty(given(personnel=rows))) == [("BURSA", "BURSA", 1)]


def test_padded_placeholder(given):
    w = given(**people({"blood_type": " BİLGİ GİRİLMEMİŞ!! "}, {"blood_type": "A+"}, {"blood_type": None}))
    row = blood.blood_kpi_summary(w).first()
    assert (row.total, row.unknown, row.a_pos) == (3, 1, 1)
    assert table(blood.blood_age_dist(w)) == [("A+", "Bilinmiyor", 1)]


def test_ties_at_the_limit_keep_the_same_rows(spark):
    rows = spark.createDataFrame([(f"k{i:02}", i) for i in range(12)], "k string, emp_id long")
    found = distribution(rows.repartition(5), [Dim("k")], PEOPLE, ["-count"], 10)
    assert table(found) == [(f"k{i:02}", 1) for i in range(10)]


def test_computed_age_bands(given):
    ages = [None, 19, 20, 29, 30, 39, 40, 49, 50]
    rows = [{"age": a} for a in ages] + [{"age": 20, "age_band": "19-29"}]
    found = dict(table(employees.employees_age_stats(given(**people(*rows)))))
    assert found == {
        "Bilinmiyor": 1,
        "20 Altı": 1,
        "20-29 Yaş": 2,
        "30-39 Yaş": 2,
        "40-49 Yaş": 2,
        "50 Üzeri": 1,
        "19-29": 1,
    }


def test_city_stats_ignore_unanswered(given):
    w = given(**people({"residence_city": None}, {"residence_city": fv.PLACEHOLDER}, {"residence_city": "X"}))
    assert table(employees.employees_city_stats(w)) == [("X", 1)]


def test_movement_kind_prefers_the_hire(given):
    rows = [
        {"org_ref": "1", "year_month": "200001", "full_name": n, "is_hire": h, "is_leaver": x}
        for n, h, x in [("a", 1, 1), ("b", 0, 1), ("c", 0, 0)]
    ]
    found = movements.turnover_details(given(personnel_month=rows)).collect()
    assert [(r.name, r.movement_type) for r in found] == [("a", fv.JOINED), ("b", fv.LEFT)]


def test_transfer_is_leaving_a_unit_but_not_the_company(given):
    rows = [
        {"org_ref": "1", "year_month": "200001", "is_hire": 0, "is_leaver": x, "left_unit": 1}
        for x in (0, 1)
    ]
    assert table(movements.turnover_timeline(given(personnel_month=rows))) == [("200001", 0, 1, 1)]


def test_missing_education_is_counted_once(given):
    w = given(**people({"education": None}, {"education": fv.PLACEHOLDER}, {"education": "LİSE"}))
    row = education.education_kpi_summary(w).first()
    assert (row.total_employees, row.no_info, row.high_school) == (3, 2, 1)


@pytest.mark.parametrize(
    "report",
    [
        employees.employees_dist_location,
        employees.employees_dist_company,
        employees.employees_dist_collar,
        employees.employees_dist_marital,
        education.education_gender_dist,
        age.age_distribution,
        blood.blood_distribution,
        location.location_duty_dist,
    ],
)
def test_groups_add_up_to_the_staff(workforce, report):
    total = report(workforce).agg(F.sum("count")).first()[0]
    assert total == staff(workforce.personnel).count()


def test_kpi_genders_do_not_exceed_the_total(workforce):
    row = employees.employees_kpi_summary(workforce).first()
    assert 0 < row.total_male + row.total_female <= row.total_active


def test_staff_filter_parts_are_optional(given):
    rows = [
        {"emp_id": i, "org_ref": o, "is_active": a, "is_regular": r}
        for i, (o, a, r) in enumerate([("1", 1, 1), ("2", 1, 1), ("1", 0, 1), ("1", 1, 0)])
    ]
    df = given(personnel=rows).personnel
    assert staff(df).count() == 1
    assert staff(df, active=None).count() == 2
    assert staff(df, regular=None).count() == 2
    assert staff(df, org=None).count() == 2
    assert staff(df, None, None, None).count() == 4


def test_random_measures_depend_on_the_row_and_the_seed_only(workforce):
    def measured(seed, parts):
        moved = workforce.personnel.repartition(parts)
        rows = datasets.full_dataset(staff(moved), seed)
        return {
            r.emp_id: (r.work_duration_years, r.leave_duration_years, r.performance_score)
            for r in rows.collect()
        }

    first = measured(1, 2)
    assert first == measured(1, 7)
    assert first != measured(2, 2)
    values = list(first.values())
    assert all(1 <= a <= 20 and 0 <= b <= 5 and 10 <= c <= 100 for a, b, c in values)
    assert all(c == int(c) for _, _, c in values)
    assert len({a for a, _, _ in values}) > 300
    assert 9.5 < sum(a for a, _, _ in values) / len(values) < 11.5


def test_dump_size(workforce):
    everyone = staff(workforce.personnel).count()
    assert datasets.dataset_heavy(workforce).count() == everyone
    assert datasets.dataset_full(workforce).count() == min(2000, everyone)


def test_text_order_is_binary_unless_a_collation_is_given(spark):
    letters = ["ı", "i", "İ", "d", "ç", "c"]
    rows = spark.createDataFrame([(x,) for x in letters], "x string")
    assert [r.x for r in ranked(rows, ["x"]).collect()] == ["c", "d", "i", "ç", "İ", "ı"]
    assert [r.x for r in ranked(rows, ["x"], collation="tr").collect()] == [
        "c", "ç", "d", "ı", "i", "İ",
    ]


def test_first_by_and_ranked(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 3), ("b", 2)], "k string, v int")
    best = first_by(rows, ["k"], [F.col("v").asc_nulls_last()])
    assert sorted(table(best)) == [("a", 1), ("b", 2)]
    assert table(ranked(rows, ["-v"], 2)) == [("a", None), ("b", 3)]
