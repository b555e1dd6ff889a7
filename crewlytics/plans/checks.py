"""Key checks, query-log clean-up and log retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from crewlytics.operators.bloom import WORDS
from crewlytics.operators.participation import EVENT
from crewlytics.operators.quality import fk_orphans, key_violations
from crewlytics.operators.query_log import normalise_queries
from crewlytics.sources.interaction_log import append_interactions, read_interactions, retain
from crewlytics.sources.log_upkeep import upkept
from crewlytics.sources.scratch import shared_folder
from crewlytics.sources.workforce import Workforce
from crewlytics.streaming.interactions import stream_to_log

LOTS = 4
LOG_AS_OF = dt.datetime(2024, 2, 5)


def key_violations_product(w: Workforce) -> DataFrame:
    return key_violations(w.product, ["id"])


def key_violations_sale(w: Workforce) -> DataFrame:
    return key_violations(w.sale, ["id"])


def key_violations_event(w: Workforce) -> DataFrame:
    return key_violations(w.training_event, ["training_event_id"])


def key_violations_participant(w: Workforce) -> DataFrame:
    return key_violations(w.training_participant, ["training_event_id", "participant_id"])


def fk_orphans_sale_product(w: Workforce) -> DataFrame:
    return fk_orphans(w.sale, w.product, {"product_id": "id"})


def fk_orphans_event_course(w: Workforce) -> DataFrame:
    return fk_orphans(w.training_event_course, w.course, {"course_id": "course_id"})


def fk_orphans_participant_event(w: Workforce, bloom_words: int = WORDS) -> DataFrame:
    """Participations of events that are not there; events without participants are not shuffled."""
    return fk_orphans(w.training_participant, w.training_event, {EVENT: EVENT}, bloom_words)


def interactions_normalised(w: Workforce) -> DataFrame:
    return normalise_queries(w.interactions)


def interactions_retained(w: Workforce, as_of: dt.datetime = LOG_AS_OF) -> DataFrame:
    return retain(w.interactions, as_of)


def interactions_appended(w: Workforce, as_of: dt.datetime = LOG_AS_OF) -> DataFrame:
    """Records written to a log and read back, without the expired ones."""
    folder = shared_folder(w.spark, "appended")
    append_interactions(w.interactions, folder)
    return retain(read_interactions(w.spark, folder), as_of).drop("day")


def interactions_upkept(w: Workforce, as_of: dt.datetime = LOG_AS_OF) -> DataFrame:
    """Records appended in several small lots, then expired and folded for good."""
    folder = shared_folder(w.spark, "upkept")
    lot = F.pmod(F.xxhash64("ts", "question"), F.lit(LOTS))
    for n in range(LOTS):
        append_interactions(w.interactions.where(lot == n), folder)
    return upkept(w.spark, folder, as_of, read_interactions).drop("day")


REPORTS = [
    key_violations_product,
    key_violations_sale,
    key_violations_event,
    key_violations_participant,
    fk_orphans_sale_product,
    fk_orphans_event_course,
    fk_orphans_participant_event,
    interactions_normalised,
    interactions_retained,
    interactions_appended,
    interactions_upkept,
]


def interactions_streamed(spark: SparkSession, directory: str) -> DataFrame:
    return stream_to_log(spark, directory)


DIRECTORY_REPORTS = [interactions_streamed]
