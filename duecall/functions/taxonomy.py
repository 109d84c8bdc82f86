"""The paper taxonomy: topics and methods that a title and an abstract name, all that match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duecall.functions import text as T

# Labels with their patterns, on text in lower case.
TOPICS = [
    ("human–AI interaction", r"human[- ](?:ai|robot)|human computer|interaction|user experience|interface|usability"),
    ("AI & machine learning", r"artificial intelligence|machine learning|deep learning|neural|transformer|language model|\bllm\b"),
    ("affective computing", r"emotion|affective|stress|sentiment|mental health"),
    ("computer vision", r"vision|image|video|visual|gaze|object detection|scene"),
    ("health & assistive technology", r"health|medical|clinical|cardiac|ecg|eeg|assistive|rehabilitation|disab|accessib"),
    ("privacy, trust & security", r"privacy|security|trust|ethical|fairness|explainab|responsib|password|federated"),
    ("XR & multimodal interaction", r"virtual reality|augmented reality|mixed reality|\bxr\b|multimodal|gesture|haptic"),
    ("robotics", r"robot|autonomous|drone"),
    ("language & conversational systems", r"language|speech|chatbot|conversation|text|hate speech|retrieval.augmented"),
    ("education & learning", r"education|learning environment|student|teaching|pedagog"),
    ("sustainability & society", r"sustainab|climate|esg|social|community|culture"),
]
METHODS = [
    ("user study", r"user study|usability|participants?|questionnaire|interview|human evaluation"),
    ("controlled experiment", r"experiment|evaluation|comparative|assessment"),
    ("qualitative study", r"qualitative|thematic analysis|interview|ethnograph"),
    ("survey or review", r"systematic review|literature review|survey|mapping study"),
    ("deep learning", r"deep learning|neural network|cnn|transformer"),
    ("LLM or generative AI", r"language model|\bllm\b|generative|retrieval.augmented|\brag\b"),
    ("privacy-preserving ML", r"federated|differential privacy|privacy.preserving"),
    ("multimodal modeling", r"multimodal|image.text|audio.visual|sensor fusion"),
    ("prototype or system", r"system|framework|platform|application|interface|tool|architecture"),
    ("case study", r"case study|deployment|in the wild|real.world"),
    ("dataset or benchmark", r"dataset|benchmark|corpus"),
]


def classified(title: Column, abstract: Column) -> Column:
    """struct(topics, methods, evidence) of a paper; a null title or abstract is an empty one."""
    title, abstract = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    evidence = F.when(abstract != "", "title-and-abstract").otherwise("title-only")
    return T.let(F.lower(F.concat(title, F.lit(" "), abstract)), lambda t: F.struct(T.labels(t, TOPICS).alias("topics"), T.labels(t, METHODS).alias("methods"), evidence.alias("evidence")))
