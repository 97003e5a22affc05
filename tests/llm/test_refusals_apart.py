"""Refusals and answers written without looking at the data or the phrases; the README gives the first figures."""

from tessera.llm import pairs

REFUSED = [
    "I'm sorry, but I can't assist with that request.",
    "Unfortunately I do not have enough information to answer your question.",
    "I am unable to provide an answer based on the given context.",
    "The provided documents do not contain the answer.",
    "There is no information about this in the sources.",
    "I couldn't find anything about that in the documents you gave me.",
    "This question cannot be answered from the available material.",
    "As an AI model, I must decline to answer this.",
    "I'd rather not comment on that topic.",
    "It is not possible for me to determine this from the text.",
    "Sorry, that is something I won't help with.",
    "We are not able to share this information.",
    "No relevant passage was found for your question.",
    "The context gives no figure for this, so I will not guess.",
    "I don't know the answer to that.",
    "My sources say nothing about it.",
    "The text does not mention this, and I have no other knowledge of it.",
    "I have no data on this subject. Please ask something else.",
    "That falls outside of what I can discuss.",
    "Insufficient information to answer.",
    "Xin lỗi, tôi không thể giúp bạn với yêu cầu này.",
    "Rất tiếc, tôi chưa có đủ thông tin để trả lời.",
    "Tôi không tìm thấy câu trả lời trong các tài liệu được cung cấp.",
    "Tài liệu không đề cập đến vấn đề này.",
    "Các nguồn hiện có không nêu thông tin này.",
    "Không có dữ liệu để trả lời câu hỏi của bạn.",
    "Tôi không biết câu trả lời.",
    "Câu hỏi này nằm ngoài phạm vi của tôi.",
    "Tôi xin phép không trả lời câu hỏi này.",
    "Thông tin được cung cấp không đủ để đưa ra câu trả lời.",
    "Chúng tôi chưa thể cung cấp nội dung này.",
    "Trong ngữ cảnh không có thông tin về việc đó.",
    "Em rất tiếc nhưng em không thể trả lời ạ.",
    "Không thể xác định được từ văn bản.",
    "Mình không có thông tin về chủ đề này.",
    "Je suis désolé, je ne peux pas répondre à cette question.",
    "Je n'ai pas trouvé cette information dans les documents.",
    "Les sources ne mentionnent pas ce sujet.",
    "Aucune information n'est disponible à ce sujet.",
    "Il m'est impossible de répondre.",
    "Nous ne disposons pas de ces données.",
    "Cette question dépasse mes compétences.",
]
ANSWERED = [
    "The ministry could not confirm the date, but the report says it was signed in 2014.",
    "No fee is charged for the first application.",
    "Farmers did not receive any subsidy that year.",
    "The plan was rejected because it had no budget.",
    "Households without land cannot apply for the loan.",
    "Không được phép xây dựng trong khu vực này.",
    "Hộ nghèo không phải nộp phí.",
    "Dự án chưa hoàn thành vào năm 2019 do thiếu vốn.",
    "Báo cáo không nêu số liệu cho Huế, nhưng tỷ lệ ở Đà Nẵng là 12%.",
    "Le ministère n'a pas publié le rapport avant mars.",
    "Aucun droit n'est dû pour la première demande.",
    "Les ménages ne paient pas cette taxe.",
    "It depends on the district office.",
    "The committee declined the request on 3 May.",
    "Prices never fell below the level of the year before.",
    "Nothing in the contract limits the number of visits.",
    "Giá không tăng trong quý đầu.",
    "Ủy ban từ chối đề nghị vì hồ sơ thiếu chữ ký.",
]


def test_recall_and_false_alarms():
    missed = [t for t in REFUSED if not pairs.is_refusal(t)]
    wrong = [t for t in ANSWERED if pairs.is_refusal(t)]
    print(missed, wrong)
    assert len(missed) <= 0.1 * len(REFUSED) and len(wrong) <= 0.1 * len(ANSWERED), (missed, wrong)
