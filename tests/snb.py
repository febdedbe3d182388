"""A tiny social network in CSV files."""

import os

FILES = {
    "static/place_0_0.csv": "id|name|url|type|isPartOf\n1|X|u|country|10\n2|Y|u|country|10\n10|Z|u|continent|\n11|xa|u|city|1\n12|yb|u|city|2\n13|X|u|city|2\n",
    "static/organisation_0_0.csv": "id|type|name|url|place\n1|company|Acme|u|1\n2|university|Uni|u|12\n",
    "static/tag_0_0.csv": "id|name|url|hasType\n1|jazz|u|2\n2|rock|u|2\n3|chess|u|3\n",
    "static/tagclass_0_0.csv": "id|name|url|isSubclassOf\n1|Thing|u|\n2|Music|u|1\n3|Game|u|1\n",
    "dynamic/person_0_0.csv": "id|firstName|lastName|gender|birthday|creationDate|locationIP|browserUsed|place|language|email\n"
    "1|Ann|A|female|0|1|i|b|11|en;de|a@x;b@x\n2|Bob|B|male|1814400000|1|i|b|12||\n3|Ann|C|female|1814400000|1|i|b|13|en|\n4|Dan|D|male|0|1|i|b|11|en|d@x\n5|Eve|E|female|0|1|i|b|13|en|\n9|Old|O|male|0|1|i|b|13|en|\n9|New|N|male|0|1|i|b|13|en|\n",
    "dynamic/forum_0_0.csv": "id|title|creationDate|moderator\n1|F one|1|1\n2|F two|1|2\n",
    "dynamic/post_0_0.csv": "id|imageFile|creationDate|locationIP|browserUsed|language|content|length|creator|Forum.id|place\n1|pic|1000|i|b|en||0|2|1|1\n2||2000|i|b|en|hello|5|3|1|2\n3||90000|i|b|en|two|3|2|2|1\n",
    "dynamic/comment_0_0.csv": "id|creationDate|locationIP|browserUsed|content|length|creator|place|replyOfPost|replyOfComment\n11|3000|i|b|c1|2|3|1|1|-1\n12|4000|i|b|c2|2|2|2||11\n13|5000|i|b|c3|2|1|1||12\n14|6000|i|b|lost|4|1|1||99\n",
    "dynamic/person_knows_person_0_0.csv": "Person.id|Person.id|creationDate\n1|2|100\n2|3|200\n3|4|300\n4|4|1\n",
    "dynamic/person_likes_comment_0_0.csv": "Person.id|Comment.id|creationDate\n3|12|64000\n",
    "dynamic/person_likes_post_0_0.csv": "Person.id|Post.id|creationDate\n3|1|1000\n1|3|0\n1|1|100\n",
    "dynamic/person_hasInterest_tag_0_0.csv": "Person.id|Tag.id\n1|1\n2|2\n",
    "dynamic/person_studyAt_organisation_0_0.csv": "Person.id|Organisation.id|classYear\n3|2|2001\n",
    "dynamic/person_workAt_organisation_0_0.csv": "Person.id|Organisation.id|workFrom\n2|1|1999\n3|1|2005\n",
    "dynamic/forum_hasMember_person_0_0.csv": "Forum.id|Person.id|joinDate\n1|2|50\n2|3|60\n1|3|10\n",
    "dynamic/forum_hasTag_tag_0_0.csv": "Forum.id|Tag.id\n1|1\n|2\n",
    "dynamic/comment_hasTag_tag_0_0.csv": "Comment.id|Tag.id\n11|2\n",
    "dynamic/post_hasTag_tag_0_0.csv": "Post.id|Tag.id\n1|1\n1|2\n2|1\n3|3\n",
}


def write(root) -> str:
    for name, text in FILES.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    return f"file://{root}"
