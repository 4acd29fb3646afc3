"""Schemas of inputs and stage tables. All ids stay strings."""

from __future__ import annotations

_PERSON = "struct<birthdate:string,age:struct<days:string,years:string>,demographics:struct<ethnicity:string,gender:string,race:string>,payerplan:string>"
_EVENT = "_type:string,_code:string,_name:string,_unit:string,_visit_id:string,_provider_id:string,_care_site_id:string,_note_id:string,_procedure_id:string,_image_id:string,_anatomic_site_source_value:string,_VALUE:string"
_SITES = "struct<caresite:array<struct<_care_site_id:string,_care_site_name:string>>>"
_PROVIDERS = "struct<provider:array<struct<_provider_id:string,_gender:string,_speciality:string,_year_of_birth:string>>>"
#: A patient's event stream, one row for each <eventstream>.
EVENTSTREAM = f"_person_id string, encounter array<struct<_start_timestamp:string,_end_timestamp:string,person:{_PERSON},caresites:{_SITES},providers:{_PROVIDERS},events:struct<entry:array<struct<_timestamp:string,event:array<struct<{_EVENT}>>>>>>>"
TIMELINE = "date string, evidence_date string, source_event_refs array<string>, type string, subtype string, modality string, site string, description string, priority string, values map<string,string>, valid_time_start string, recorded_times array<string>, event_id string, patient_id string"
EPISODE = "patient_id string, episode_id string, kind string, start_date string, end_date string, anchor_event_id string, anchor_event_ids array<string>, event_ids array<string>, line_number int, intent string, treatment string, termination_reason string, response_status string, disease_state string, imaging_group string, clinical_context string, label string"
ELIGIBILITY = "patient_id string, first_tb_encounter_date string"
CHUNK = f"events array<struct<{', '.join(c.replace(' ', ':', 1) for c in TIMELINE.split(', '))}>>, background struct<smoking:string,comorbidities:array<string>,allergies:array<string>,family_history:array<string>>"
