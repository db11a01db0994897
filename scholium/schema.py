"""The canonical ten-table model and the shapes of source records."""

from __future__ import annotations

TABLES = {
    "works": "work_id string, doi string, external_id string, title string, abstract string, year long, publication_date string, document_type string, language string, source_id string, volume string, issue string, pages string, publisher string, cited_by_count long, reference_count long, is_retracted boolean, source_record_hash string",
    "authors": "author_id string, name string, given_name string, family_name string, orcid string",
    "institutions": "institution_id string, name string, ror string, country_code string",
    "authorships": "work_id string, author_id string, institution_id string, position long, is_corresponding boolean",
    "sources": "source_id string, name string, issn string, publisher string, source_type string",
    "keywords": "work_id string, keyword string, keyword_type string, score double",
    "topics": "work_id string, topic_id string, topic string, score double, field string",
    "references": "citing_work_id string, cited_work_id string, cited_doi string, cited_title string, cited_author string, cited_year long, source string",
    "provenance": "work_id string, source string, source_record_id string, source_record_hash string",
    "duplicates": "kept_work_id string, removed_work_id string, rule string",
}
EXCLUDED = "work_id string, source string, source_record_id string, source_record_hash string, publication_year long, rule string, detail string"

_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF = (
    "DOI string, URL string, title array<string>, abstract string, "
    f"published {_DATE}, issued {_DATE}, `published-online` {_DATE}, `published-print` {_DATE}, created {_DATE}, "
    "type string, language string, `container-title` array<string>, ISSN array<string>, "
    "author array<struct<given:string,family:string,ORCID:string,affiliation:array<struct<name:string>>>>, subject array<string>, "
    "reference array<struct<DOI:string,`article-title`:string,author:string,year:string,unstructured:string>>, "
    "`references-count` long, `is-referenced-by-count` long, publisher string, volume string, issue string, page string, `update-to` array<struct<DOI:string>>"
)
_SOURCE = "struct<id:string,display_name:string,issn_l:string,issn:array<string>,type:string,host_organization_name:string>"
OPENALEX = (
    "id string, doi string, title string, display_name string, abstract_inverted_index map<string,array<int>>, publication_year long, publication_date string, "
    f"type string, language string, primary_location struct<source:{_SOURCE}>, biblio struct<volume:string,issue:string,first_page:string>, "
    "cited_by_count long, referenced_works_count long, is_retracted boolean, "
    "authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<id:string,display_name:string,ror:string,country_code:string>>,is_corresponding:boolean>>, "
    "keywords array<struct<display_name:string>>, topics array<struct<id:string,display_name:string,score:double,field:struct<display_name:string>>>, referenced_works array<string>"
)
EUROPE_PMC = (
    "id string, source string, doi string, title string, abstractText string, pubYear string, firstPublicationDate string, language string, pageInfo string, "
    "pubTypeList struct<pubType:array<string>>, journalInfo struct<volume:string,issue:string,journal:struct<title:string,issn:string>>, citedByCount long, hasReferences string, isRetracted boolean, "
    "authorList struct<author:array<struct<fullName:string,firstName:string,lastName:string,authorIdList:struct<authorId:array<struct<type:string,value:string>>>,authorAffiliationDetailsList:struct<authorAffiliation:array<struct<affiliation:string>>>>>>, "
    "meshHeadingList struct<meshHeading:array<struct<descriptorName:string>>>, keywordList struct<keyword:array<string>>, "
    "_references array<struct<doi:string,source:string,id:string,title:string,authorString:string,pubYear:string>>"
)
