"""Review comments in packages: a part of comments, their anchors in the paragraphs, and what makes the part known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources import parts, word

#: Names that packages use for comments.
PART, KIND = "word/comments.xml", f"{parts.KINDS}/comments"
CONTENT_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"


def numbered(comments: DataFrame) -> DataFrame:
    """comments(doc_id, pos, rule_id, comment) -> with id, from 0 by place and rule in each document."""
    return comments.withColumn("id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "rule_id")) - 1).cast("int"))


def comments_part(of: DataFrame, author: str) -> DataFrame:
    """numbered() -> doc_id, part, content: the comments of each document."""
    number = F.col("id").cast("string")
    one = F.concat(F.lit('<w:comment w:id="'), number, F.lit('" w:author="'), word.escaped(F.lit(author)), F.lit('"><w:p><w:r><w:t xml:space="preserve">'), word.escaped(F.col("comment")), F.lit("</w:t></w:r></w:p></w:comment>"))
    inner = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", one.alias("xml")))), lambda x: x["xml"]), "")
    return of.groupBy("doc_id").agg(F.lit(PART).alias("part"), F.encode(F.concat(F.lit(f"<w:comments {parts.SPACES}>"), inner, F.lit("</w:comments>")), "UTF-8").alias("content"))


def anchored(body: Column, numbers: Column) -> Column:
    """The XML of a paragraph with the ranges of comments, an array of ids, around its content; its properties stay first."""
    tags = lambda name: F.array_join(F.transform(numbers, lambda n: F.concat(F.lit(f'<w:{name} w:id="'), n.cast("string"), F.lit('"/>'))), "")
    marks = F.array_join(F.transform(numbers, lambda n: F.concat(F.lit('<w:r><w:commentReference w:id="'), n.cast("string"), F.lit('"/></w:r>'))), "")
    head = F.regexp_extract(body, r"^(<w:p(?:\s[^>]*)?>(?:<w:pPr>.*?</w:pPr>|<w:pPr/>)?)", 1)
    inner = F.regexp_replace(F.substring(body, F.length(head) + 1, F.length(body)), "</w:p>$", "")
    return F.when(F.coalesce(F.size(numbers), F.lit(0)) > 0, F.concat(head, tags("commentRangeStart"), inner, tags("commentRangeEnd"), marks, F.lit("</w:p>"))).otherwise(body)


def made_known(found: DataFrame, of: DataFrame) -> DataFrame:
    """found(doc_id, part, content): the types and the main part's relationships of packages; of(doc_id): those that get comments -> the same parts with
    an entry for the comments, where they have none; all else in them stays byte for byte."""
    text = F.decode("content", "UTF-8")
    kind = F.lit(f'<Override PartName="/{PART}" ContentType="{CONTENT_TYPE}"/></Types>')
    edge = F.lit(f'<Relationship Id="rIdReview" Type="{KIND}" Target="comments.xml"/></Relationships>')
    new = F.when(F.col("part") == "[Content_Types].xml", F.replace(text, F.lit("</Types>"), kind)).when(F.col("part") == "word/_rels/document.xml.rels", F.replace(text, F.lit("</Relationships>"), edge))
    chosen = found.join(of.select("doc_id").distinct(), "doc_id", "left_semi").where(new.isNotNull() & ~F.contains(text, F.lit("comments.xml")))
    return chosen.select("doc_id", "part", F.encode(new, "UTF-8").alias("content"))
